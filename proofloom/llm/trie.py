"""Prefix trie of conversations, encoded by preorder intervals.

The distinct prefixes of conversations are the nodes. Distinct conversations are
ranked lexicographically, so that those below a node are neighbours: a node has
the interval of ranks from its first to its last conversation, nodes sorted by
(first rank, depth) stand in preorder, and a subtree ends where the last node of
the interval's end stands. Leaves and saved tokens of a subtree are differences of
two prefix sums over that order, which are summed in parallel (:mod:`.scans`).

No conversation is ever in one row, since one may hold a large share of all
turns: places in a conversation and hashes of its prefixes are running sums over
sorted turns (a prefix's hash is the exclusive or of hashes of its (turn, place)
pairs, 128 bits), and ranks come from naming: runs of ``RUN`` turns are ranked,
then runs of that many ranks, until one rank stands for the whole. Equal
conversations are counted once and weighed by their number. Texts are read once,
to sort and to hash them; afterwards a turn is 16 bytes and a length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import identifier, saved, small_batches, trim
from .scans import running

RUN = 32
#: A conversation begins with up to SHARED - 1 turns of the first of its HUNDRED.
SHARED, HUNDRED = 6, 100
#: Ids are hashed in pieces of about this many bytes.
PIECE = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
#: DuckDB SQL of :func:`nodes` over ``conversations``; sequences are lists there, and preorder is the order of the lists of turn hashes.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) p
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT i, 0 k, i::BIGINT v FROM range(256) b(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
step AS (SELECT i, v FROM bits WHERE k = 8),
crc AS (SELECT DISTINCT c, 1 p, 4294967295::BIGINT v FROM t
  UNION ALL SELECT c, p + 1, xor(crc.v >> 8, step.v) FROM crc JOIN step ON step.i = xor(crc.v & 255, ascii(substr(c::VARCHAR, p, 1))) WHERE p <= length(c::VARCHAR)),
h AS (SELECT c, xor(v, 4294967295) % 6 h FROM crc WHERE p = length(c::VARCHAR) + 1),
turns AS (
  SELECT h.c, 0 part, t.p, t.r, t.x FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.p <= h.h
  UNION ALL SELECT h.c, 1, t.p, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.p > h.h),
seq AS (SELECT h.c, coalesce(list({'k': sha256(length(r)::VARCHAR || ':' || r || x)[:32], 'n': length(x)} ORDER BY part, p) FILTER (p IS NOT NULL), []) s FROM h LEFT JOIN turns USING (c) GROUP BY h.c),
pre AS (SELECT c, s, unnest(range(len(s) + 1)) d FROM seq),
node AS (SELECT list_transform(s[:d], lambda e: e.k) q, d, min(c) conv_id, count(*) n_convs, any_value(CASE WHEN d > 0 THEN s[d].n ELSE 0 END) n,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d) ids FROM pre GROUP BY ALL),
tree AS (SELECT *, (n_convs - 1) * n saving, row_number() OVER (ORDER BY q) preorder FROM node),
sums AS (SELECT a.q, a.d, a.conv_id, a.n_convs, a.ids, a.preorder, count(b.q) FILTER (b.d = a.d + 1) n_children, sum(b.saving)::BIGINT saved_tokens, max(b.preorder) "end"
  FROM tree a JOIN tree b ON b.d >= a.d AND b.q[:a.d] = a.q GROUP BY ALL)
SELECT a.conv_id, a.d depth, p.conv_id parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) n_leaves, a.saved_tokens,
  sha256(coalesce(a.ids, '')) ends_sha256, a.preorder, a."end"
FROM sums a JOIN sums b ON b.preorder BETWEEN a.preorder AND a."end" LEFT JOIN sums p ON p.d = a.d - 1 AND p.q = a.q[:p.d] GROUP BY ALL
"""


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn_key, chars): the turns of each conversation in order, from 1."""
    for c in (conv_id, turn, role, text):
        identifier(c)
    own = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))
    )
    own = own.select("conv", "turn", "role", "text", F.lit(1).cast("long").alias("one"))
    small_batches(conversations.sparkSession)
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    # what sorts turns of one number goes through the sort as it is; the sums need ids and numbers only
    order = ["conv", "turn", "role", "text"]
    keyed = own.repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = keyed.select("conv", F.monotonically_increasing_id().alias("at"), "one", F.substring(F.sha2(whole, 256), 1, 32).alias("turn_key"), F.length("text").cast("long").alias("chars"))
    keyed = saved(keyed, "trie-keys")
    return running(keyed, ["conv", "at"], {"pos": "one"}, group="conv", name="trie-turns").select("conv", "pos", "turn_key", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (conv, n) of each, and (conv, pos, turn_key, chars, n) of their turns."""
    own = own.withColumn("base", F.col("conv") - F.col("conv") % HUNDRED)
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h")
    sizes = own.groupBy("conv", "base").agg(F.max("pos").alias("size")).select("*", shared)
    heads = own.filter(f"conv = base and pos < {SHARED}").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_key", "chars"))).alias("head"))  # SHARED - 1 turns at most
    convs = sizes.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos:bigint,turn_key:string,chars:bigint>>)")), F.lit(1), F.col("h").cast("int")))
    convs = saved(convs.select("conv", "h", "head", (F.size("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n")), "trie-conversations")
    begin = convs.select("conv", "n", F.inline("head")).select("conv", "pos", "turn_key", "chars", "n")
    rest = own.join(convs.select("conv", "h", "n", F.size("head").alias("k")), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_key", "chars", "n")
    return convs.select("conv", "n"), begin.union(rest)


def _ranks(runs: DataFrame, key: str) -> DataFrame:
    """(key, name): the place of each distinct value among all, from 1."""
    once = runs.groupBy(key).agg(F.lit(1).cast("long").alias("one"))
    return running(once, [key], {"name": "one"}, name="trie-names").select(key, "name")


def ranked(members: DataFrame) -> DataFrame:
    """(conv, rank) of sequences in lexicographic order, from 1: those of (conv, pos from 1, turn_key) that have turns. No two are alike."""
    level = members.select("conv", "pos", F.col("turn_key").alias("name"))
    while True:
        runs = level.groupBy("conv", (F.floor((F.col("pos") - 1) / RUN) + 1).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("run"))  # RUN entries at most
        runs = saved(runs.select("conv", F.col("pos").cast("long").alias("pos"), F.col("run.name").alias("run")), "trie-runs")
        level = saved(runs.join(_ranks(runs, "run"), "run").select("conv", "pos", "name"), "trie-level")
        if level.agg(F.coalesce(F.max("pos"), F.lit(1))).first()[0] == 1:
            return level.select("conv", F.col("name").alias("rank"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h1, h2, depth, conv) to pieces of comma-joined ids of one node."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    node, first, ids, size = None, None, [], 0
    done: list[tuple] = []
    for b in batches:
        for *own, conv in zip(*(c.to_pylist() for c in b.columns)):
            if own != node or size >= PIECE:
                if ids:
                    done.append((*node, first, ",".join(ids)))
                node, first, ids, size = own, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
            done = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, first, ",".join(ids)), schema.types)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (h1, h2, depth, sha256), a piece at a time."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, sha = None, None
    done: list[tuple] = []
    for b in batches:
        for *own, _, ids in zip(*(c.to_pylist() for c in b.columns)):
            if own == node:
                sha.update(b",")
            else:
                if sha:
                    done.append((*node, sha.hexdigest()))
                node, sha = own, hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
            done = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, sha.hexdigest()), schema.types)], schema=schema)
    trim()


def ends(members: DataFrame) -> DataFrame:
    """(h1, h2, depth, ends_sha256) over (h1, h2, depth, conv): the hash of each node's ids, ascending.

    A node's ids are formatted in as many tasks as they fill; the hash, which has
    to go in order, then passes over a piece of text for thousands of ids.
    """
    order = ["h1", "h2", "depth", "conv"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "h1 long, h2 long, depth long, first long, ids string")
    return pieces.repartition("h1", "h2", "depth").sortWithinPartitions("h1", "h2", "depth", "first").mapInArrow(_hashed, "h1 long, h2 long, depth long, ends_sha256 string")


def encoded(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and preorder: place from 1 and end of the subtree.

    convs: (conv, n turns); rows: (conv, pos from 1, turn_key, chars, n).
    """
    part = lambda seed: F.xxhash64(F.lit(seed), "turn_key", "pos")
    own = rows.select("conv", "pos", "turn_key", "chars", "n", part(1).alias("f1"), part(2).alias("f2"))
    own = running(own, ["conv", "pos"], {}, {"h1": "f1", "h2": "f2"}, group="conv", name="trie-prefixes")
    zero = F.lit(0).cast("long")
    last = own.filter("pos = n").select("h1", "h2", F.col("pos").alias("depth"), "conv").union(convs.filter("n = 0").select(zero, zero, zero, "conv"))
    last = saved(last, "trie-last")
    distinct = saved(last.groupBy("h1", "h2", "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("copies")), "trie-distinct")
    kept = saved(own.join(distinct.select("conv", "copies"), "conv"), "trie-kept")
    rank = saved(distinct.filter("depth = 0").select("conv", zero.alias("rank")).union(ranked(kept)), "trie-ranks")  # without turns: before all others
    below = kept.select("conv", "copies", F.col("pos").alias("depth"), "h1", "h2", F.col("h1").bitwiseXOR(F.col("f1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("f2")).alias("p2"), "chars")
    below = below.union(distinct.select("conv", "copies", zero, zero, zero, zero, zero, zero))  # the root is over all
    nodes = below.join(rank, "conv").groupBy("h1", "h2", "depth").agg(
        F.min("conv").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars")
    )
    nodes = saved(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["h1", "h2", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("chars"), "one": F.lit(1).cast("long")})
    placed = running(nodes, ["low", "depth"], {"preorder": "one", "leaves": "leaf", "savings": "saving"}, name="trie-preorder")
    # the last node of a rank is the whole conversation of that rank
    end = placed.groupBy(F.col("low").alias("high")).agg(F.max("preorder").alias("end"), F.max("leaves").alias("leaves_end"), F.max("savings").alias("savings_end"))
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = placed.join(end, "high").join(parents.filter("depth > 0"), ["p1", "p2", "depth"], "left").join(ends(last), ["h1", "h2", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("savings_end") - F.col("savings") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"), "preorder", "end",
    )


def nodes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations (:func:`rebuilt`), a row per node: see :func:`encoded`.

    Turns go by number, nulls first, those of one number by role, then text. Null
    role or text: empty. Null conv_id: the row takes no part. Repeated rows are
    turns of their own. Conversations without turns are members of the root.
    Empty table: no rows, not even a root. Text lengths are code points.
    """
    return encoded(*rebuilt(turns(conversations, conv_id, turn, role, text)))
