"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint holds, for each of 64 bits, whether the bit is set in
over half of its shingle hashes. Two fingerprints link if at most ``radius``
bits differ. A covering family finds every such pair: each bit position has a
nonzero vector of radius+1 bits, and table v (v nonzero) keeps the positions
whose vector has an odd product with v. The at most ``radius`` vectors of the
differing bits leave some nonzero v orthogonal to all of them, so that table
masks every difference away and the pair shares a bucket there.

Buckets hold distinct fingerprints, copies being one row. A bucket beyond
``bucket_rows`` is split again by a second covering family over the bits its
mask left free, and so on: each level fixes more than half of the free bits, so
that a bucket of k free bits ends below 2^k rows, without losing a link. Inside
a bucket the task emits a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import may_match, parts, saved, small_batches, texts, trim, words
from .components import components

BUCKET_ROWS = 2048


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint; no words: zero."""
    w = words(text)
    if not w:
        return 0
    line = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) < width:
        hashes = [h(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *ends[:-1].tolist()]
        hashes = [h(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):  # bounded memory, however long the text
        bits += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, fp long) for each row; fp is the fingerprint's bits as a signed long.

    Null or wordless text: fp 0. Repeated rows stay. Very long texts are hashed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])
        trim()

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """The 2^(radius+1) - 1 masks over the given bit positions (default all 64)."""
    bits = list(range(64)) if bits is None else bits
    top = (1 << (radius + 1)) - 1
    cycle = sorted(range(1, top + 1), key=lambda v: (v.bit_count() > 1, v))  # unit vectors first: over radius+1 bits or more, no mask is empty
    vectors = {b: cycle[i % top] for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vectors[b] & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _free(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct ``fps`` (int64) at ``radius`` bits or fewer."""
    u = fps.view(np.uint64)
    n, out = len(u), []
    left = np.ones(n, bool)
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(u[rest] ^ u[i]) <= radius]
            left[near] = False
            queue.extend(near.tolist())
            out.extend((int(fps[i]), int(fps[j])) for j in near)
    return out


def _runs(radius: int, most: int):
    """Reads rows (path, key, fp) sorted by path and key; emits links, and the rows of buckets beyond ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
        at, held, over = None, [], False

        def flush() -> list[tuple]:
            return [(None, a, b) for a, b in forest(np.array(held, np.int64), radius)] if not over and len(held) > 1 else []

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            path, key, fp = (b.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            rows: list[tuple] = []
            starts, ends = np.append(0, new), np.append(new, len(path))
            own = ends - starts > 1
            own[[0, -1]] = True  # a run of one row matters only where it may go on in another batch
            for i, j in zip(starts[own].tolist(), ends[own].tolist()):
                if i == j:
                    continue
                if (path[i], key[i]) != at:
                    rows += flush()
                    at, held, over = (path[i], key[i]), [], False
                if over:
                    rows += [(int(path[i]), int(x), None) for x in fp[i:j]]
                elif len(held) + j - i > most:
                    rows += [(int(path[i]), x, None) for x in [*held, *map(int, fp[i:j])]]
                    held, over = [], True
                else:
                    held += map(int, fp[i:j])
            if rows:
                yield pack(rows)
        if at is not None and (rows := flush()):
            yield pack(rows)

    return run


def links(distinct: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u long, v long) that join all fingerprints of ``distinct`` (fp long, no repeats) within ``radius`` bits.

    Links are a spanning forest of each bucket: two fingerprints are connected
    by links if and only if they are by pairs within the radius. The result is
    a written table. Empty input: no rows.
    """
    bucket_rows = max(bucket_rows, 2 << radius)  # more than the buckets hold whose masks could not shrink
    found = []
    masks = {0: 0}  # path -> bits that all rows of its buckets share
    rows = distinct.select(F.lit(0).cast("long").alias("path"), "fp")
    while True:
        nxt, arms = {}, []
        for path, mask in masks.items():
            for i, m in enumerate(covering_masks(radius, _free(mask))):
                arms.append((path, path * (2 << radius) + 1 + i, _signed(m | mask)))
                nxt[arms[-1][1]] = m | mask
        tables = distinct.sparkSession.createDataFrame(arms, "path long, to long, mask long")  # at most 2^(radius+1) for each split table
        dealt = rows.join(F.broadcast(tables), "path").select(F.col("to").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        out = saved(
            dealt.repartition(parts(distinct), "path", "key").sortWithinPartitions("path", "key").mapInArrow(_runs(radius, bucket_rows), "path long, u long, v long"),
            "links",
        )
        found.append(out.filter("path is null").select("u", "v"))
        rows = out.filter("path is not null").select("path", F.col("u").alias("fp")).distinct()
        big = [r[0] for r in rows.select("path").distinct().collect()]  # at most the masks of a level
        masks = {p: nxt[p] for p in big if _free(nxt[p])}
        if not masks:
            break
    return reduce(DataFrame.union, found)


def classes(docs: DataFrame, width: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id long, fp long, component_id long) for each row of ``docs``.

    component_id is the smallest doc_id that links reach, itself included.
    Wordless and null texts have fingerprint zero and link like any other.
    Repeated rows give repeated results; a null doc_id is kept, and is never
    the smallest while its component has another. Empty input: no rows.
    """
    fps = saved(fingerprints(docs, width, doc_id, text), "fps")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    edges = links(distinct.select("fp"), radius, bucket_rows)
    roots = components(edges)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Copies alike in four fifths of their five-word shingles: fingerprints of the words that the covering tables are over, and radius in each.
PRINTS, PRINT_RADIUS = 6, 3
#: The 256-bit fingerprint of the shingles. Jaccard 0.8 is a cosine of 0.89, an angle of 0.15 pi, 39 bits of 256 (deviation 5.7): pairs of up to
#: LOOSE_BITS are candidates, whose sets of shingles are compared; SHINGLE_BITS decide only where a caller of :func:`alike` asks for it.
SHINGLE, SHINGLE_WORDS, SHINGLE_BITS, LOOSE_BITS = 5, 4, 46, 54
#: Paths kept for the tables of each fingerprint, those that split them included.
PATHS = (2 << PRINT_RADIUS) ** 6
#: Texts of up to SHORT shingles, whose word fingerprints an edit moves far, also meet by BANDS keys of BAND_MINS least shingle hashes each:
#: a pair of 0.8 has a key in common with probability 1 - (1 - 0.8^3)^10 = 0.9992.
SHORT, BANDS, BAND_MINS = 64, 10, 3
BAND_PATH = PRINTS * (PATHS + 1)
#: Rows up to which all pairs of a bucket are compared at once, and from which up to which rows near to no other are left out first.
DENSE_ROWS, LONE_ROWS = 2048, (256, 1 << 15)
#: Sets of shingles compared in one task: texts and their bytes. A larger group of candidates is dealt into blocks of half of it, and a task has two of them.
TASK_TEXTS, TASK_BYTES = 1 << 14, 32 << 20
_SPREAD = np.random.default_rng(20).integers(0, 1 << 63, BANDS * BAND_MINS, np.uint64) * np.uint64(2) + np.uint64(1)


def _majority(raw: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bits set in hashes (rows of ``raw``) of over half of the total weight."""
    bits = np.zeros(8 * raw.shape[1])  # whole numbers, far below 2^53
    for i in range(0, len(raw), 4096):  # bounded memory, however long the text
        bits += weights[i : i + 4096].astype(np.float64) @ np.unpackbits(raw[i : i + 4096], axis=1).astype(np.float64)
    return np.packbits(bits * 2 > weights.sum())


def _grams(ws: list[bytes]) -> list[bytes]:
    """The shingles of a text's words, in order; fewer words: the whole sequence."""
    line, n = b" ".join(ws), len(ws)
    if n < SHINGLE:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1)
    return [line[i:j] for i, j in zip([0, *ends[:-SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist())]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys (signed) of a set of shingle hashes: each of BAND_MINS least values under hash functions of its own."""
    least = _mixed(hashes[None, :] * _SPREAD[:, None]).min(1).reshape(BANDS, BAND_MINS)
    key = least[:, 0]
    for k in range(1, BAND_MINS):
        key = _mixed(key + least[:, k])
    return key.view(np.int64).tolist()


def wide_prints(batch: list[bytes]) -> tuple[list[bytes], np.ndarray, list[list[int] | None]]:
    """Of each text, a digest of its word sequence, words of 64 bits, and the band keys of a short text.

    The words of 64 bits are PRINTS fingerprints of its words, and one of 256
    bits of its shingles. A word counts as often as it stands in shingles, so
    that an edit moves the fingerprints no more than the shingles.
    """
    split = [words(t) for t in batch]
    out, keys = np.zeros((len(batch), 8 * (PRINTS + SHINGLE_WORDS)), np.uint8), []
    h, known = xxhash.xxh3_128_digest, {}
    for k, ws in enumerate(split):
        n = len(ws)
        times = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(SHINGLE, max(n - SHINGLE + 1, 1)))
        place: dict[bytes, int] = {}
        ids = np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int64, n)
        for w in place:
            if w not in known:
                known[w] = hashlib.blake2b(w, digest_size=8 * PRINTS).digest()
        raw = np.frombuffer(b"".join(map(known.__getitem__, place)), np.uint8).reshape(len(place), 8 * PRINTS)
        grams = _grams(ws)
        hashes = np.frombuffer(b"".join(x for g in grams for x in (h(g), h(g, 1))), np.uint8).reshape(len(grams), 8 * SHINGLE_WORDS)
        out[k] = np.concatenate([_majority(raw, np.bincount(ids, times, len(place)).astype(np.int64)), _majority(hashes, np.ones(len(grams), np.int64))])
        keys.append(band_keys(hashes.view(np.uint64)[:, 0]) if len(grams) <= SHORT else None)
    return [hashlib.md5(b" ".join(ws)).digest() for ws in split], out.view(np.uint64), keys


def _met(prints: np.ndarray, most: int) -> np.ndarray:
    """The rows that differ from some other row in ``most`` bits or fewer. The second half of the words is counted only where the first does not tell."""
    n, wide = prints.shape
    half, words_ = (wide + 1) // 2, np.ascontiguousarray(prints.T)
    met = np.zeros(n, bool)
    for at in range(0, n, 64):
        bits = sum(np.bitwise_count(words_[k, at : at + 64, None] ^ words_[k, None, at:]).astype(np.int16) for k in range(half))
        r, c = np.nonzero(bits <= most)
        r, c = r[r < c], c[r < c]
        bits = bits[r, c] + sum(np.bitwise_count(words_[k, at + r] ^ words_[k, at + c]).astype(np.int16) for k in range(half, wide))
        met[at + r[bits <= most]] = met[at + c[bits <= most]] = True
    return np.flatnonzero(met)


def judged_pairs(prints: np.ndarray, most: int = SHINGLE_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows (fingerprints of shingles) that differ in ``most`` bits or fewer, whatever their number; room for a few columns of the rows."""
    n, wide = prints.shape
    if LONE_ROWS[0] < n <= LONE_ROWS[1]:
        own = _met(prints, most)
        if len(own) < n:
            return [(int(own[i]), int(own[j])) for i, j in judged_pairs(prints[own], most)] if len(own) else []
    copies = lambda x, y: sum(np.bitwise_count(x[..., k] ^ y[..., k]).astype(np.int16) for k in range(wide)) <= most
    near = copies(prints[:, None], prints[None]) if n <= DENSE_ROWS else None
    rest, out = np.arange(n), []  # rows that no tree has yet
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            found = near[i, rest] if near is not None else copies(prints[rest], prints[i])
            if found.any():
                more = rest[found].tolist()
                rest = rest[~found]
                queue.extend(more)
                out.extend((i, j) for j in more)
    return out


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; never empty."""
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, _grams(words(text))), np.uint64))


def exact_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` whose Jaccard similarity is 0.8 or more.

    One set is compared with all that no tree has yet at once. A tree starts at
    the set whose elements are the commonest ones, so that a text with many
    copies takes most of them in one step.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.append(0, np.cumsum(sizes))
    often = np.bincount(local)
    order = np.argsort(-np.add.reduceat(often[local], starts[:-1]) / sizes, kind="stable")
    own = [local[starts[i] : starts[i + 1]].astype(np.int32) for i in range(n)]
    mark = np.zeros(len(often), np.int8)
    rest, out = order, []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        flat = None
        while queue and len(rest):
            if flat is None:
                flat, at = np.concatenate([own[j] for j in rest]), np.append(0, np.cumsum(sizes[rest])[:-1])
            i = queue.pop()
            mark[own[i]] = 1
            both = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[own[i]] = 0
            found = 9 * both >= 4 * (sizes[i] + sizes[rest])  # both / (a + b - both) >= 4 / 5
            if found.any():
                more = rest[found].tolist()
                rest, flat = rest[~found], None
                queue.extend(more)
                out.extend((i, j) for j in more)
    return out


def _exact_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (group, block, block, node, text) sorted by all but the text; emits links (u, v) of the nodes of two blocks of a group. Repeated nodes count once."""
    group, nodes, sets = None, [], []

    def flush() -> list[tuple[int, int]]:
        return [(nodes[i], nodes[j]) for i, j in exact_pairs(sets)] if len(nodes) > 1 else []

    def pack(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["u", "v"])

    for b in batches:
        rows: list[tuple[int, int]] = []
        keys = zip(*(b.column(i).to_pylist() for i in range(3)))
        for g, node, text in zip(keys, b.column(3).to_pylist(), texts(b.column(4))):
            if g != group:
                rows += flush()
                group, nodes, sets = g, [], []
            if not nodes or node != nodes[-1]:
                nodes.append(node)
                sets.append(shingle_set(text))
        if rows:
            yield pack(rows)
    if rows := flush():
        yield pack(rows)
    trim()


def _print_runs(most: int, kinds: dict[int, int]):
    """Reads rows (path, key, node, print, shingle fingerprint...) sorted by path and key; emits for each of ``kinds`` and its
    bits candidates (kind, u, v) of a bucket's nodes, and rows (path, node, null).

    The rows are those of buckets of more than ``most`` distinct fingerprints,
    to be dealt again. Nodes of one fingerprint can't be dealt apart, so any
    number of them is judged together, a few words of memory each.
    """
    schema = pa.schema([("path", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, seen, over = None, [], 0, None, False

        def flush() -> list[tuple]:
            if over or size < 2:
                return []
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            prints = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
            return [(kind, int(rows[i, 0]), int(rows[j, 0])) for kind, bits in kinds.items() for i, j in judged_pairs(prints, bits)]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            path, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            body = np.stack([b.column(i).to_numpy() for i in range(2, 4 + SHINGLE_WORDS)], axis=1)
            new = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.append(0, new), np.append(new, len(path))
            own = ends - starts > 1
            own[[0, -1]] = True  # a run of one row matters only where it may go on in another batch
            rows: list[tuple] = []
            for i, j in zip(starts[own].tolist(), ends[own].tolist()):
                if i == j:
                    continue
                if (path[i], key[i]) != at:
                    rows += flush()
                    at, held, size, seen, over = (path[i], key[i]), [], 0, None, False
                held.append(body[i:j])
                size += j - i
                if size > most and not over:
                    seen = np.unique(np.concatenate([x[:, 1] for x in held] if seen is None else [seen, body[i:j, 1]]))
                    over = len(seen) > most
                if over:
                    rows += [(int(path[i]), x, None) for part in held for x in part[:, 0].tolist()]
                    held = []
            if rows:
                yield pack(rows)
        if rows := flush():
            yield pack(rows)

    return run


def _candidates(same: DataFrame, cols: list[str], n_parts: int, bucket_rows: int, kinds: dict[int, int]) -> DataFrame:
    """(kind, u, v): forests of the nodes of each bucket, for each of ``kinds`` (below zero) at its bits.

    Buckets are those of the covering tables over each word fingerprint, split
    as in :func:`links`, and those of the band keys of short texts. A band's
    bucket of more than ``bucket_rows`` different fingerprints is split by the
    keys of all other bands.
    """
    run_pairs = _print_runs(bucket_rows, kinds)
    sketch = cols[PRINTS:]
    out, nodes = [], same.withColumn("only", F.explode(F.array(*[F.lit(k) for k in range(PRINTS)])))
    banded = same.filter("bands is not null").select("*", F.posexplode("bands").alias("band", "key"))
    banded = banded.select((F.col("band") + BAND_PATH).alias("path"), "key", "node", F.col(cols[0]).alias("print"), *sketch)
    # table v of fingerprint k is path PRINTS + k * PATHS + v; the tables that split it are known by their paths
    size = 2 << PRINT_RADIUS
    arms = [(k, PRINTS + k * PATHS + v, k, m) for k in range(PRINTS) for v, m in enumerate(covering_masks(PRINT_RADIUS))]
    while arms or banded is not None:
        masks = same.sparkSession.createDataFrame([(o, p, k, _signed(m)) for o, p, k, m in arms], "only int, path int, k int, mask long")  # at most 15 for each split table
        dealt = nodes.join(F.broadcast(masks), "only").withColumn("print", F.element_at(F.array(*cols[:PRINTS]), F.col("k") + 1))
        dealt = dealt.select("path", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "node", "print", *sketch)
        if banded is not None:
            dealt = dealt.unionByName(banded)
        found = saved(dealt.repartition(n_parts, "path", "key").sortWithinPartitions("path", "key").mapInArrow(run_pairs, "path int, u long, v long"), "pairs")
        out.append(found.filter("path < 0").withColumnRenamed("path", "kind"))
        over = found.filter("path >= 0").select(F.col("path").alias("only"), F.col("u").alias("node")).distinct()
        mask_of = {p: (k, m) for _, p, k, m in arms}
        arms, banded = [], None
        nodes = over.join(same, "node")
        for (p,) in over.select("only").distinct().collect():  # at most the masks of a level
            if p >= BAND_PATH:
                own = nodes.filter(F.col("only") >= BAND_PATH).withColumn("band", F.col("only") - BAND_PATH)
                own = own.select("*", F.posexplode("bands").alias("other", "key2")).filter("other <> band")
                key = F.xxhash64(F.element_at("bands", F.col("band") + 1), "key2")
                path = F.lit(BAND_PATH + BANDS) + F.col("band") * BANDS + F.col("other")
                banded = own.select(path.alias("path"), key.alias("key"), "node", key.alias("print"), *sketch)
                continue
            k, m = mask_of[p]
            free = _free(m)
            for v, more in enumerate(covering_masks(PRINT_RADIUS, free) if len(free) > PRINT_RADIUS else []):
                arms.append((p, PRINTS + k * PATHS + (p - PRINTS - k * PATHS + 1) * size + v, k, m | more))
    return reduce(DataFrame.union, out)


def alike(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, group_texts: int | None = None, task_texts: int = TASK_TEXTS) -> DataFrame:
    """(doc_id, text_key, group, root) for each row of ``docs`` that has a doc_id: documents of one group are copies of each other.

    Two documents are linked if their words are the same, or if the sets of
    their five-word shingles have a Jaccard similarity of 0.8 or more.
    Candidates are pairs whose 256-bit SimHash of the shingles differs in at
    most LOOSE_BITS bits, taken from covering tables over fingerprints of the
    words, which edits move much less than shingles, and for short texts from
    bands of least shingle hashes. The texts of each connected group of
    candidates are compared exactly, whatever its size: a group of more than
    ``task_texts`` different texts or TASK_BYTES is dealt into blocks, and each
    two of its blocks are compared in one task. Only if ``group_texts`` is
    given, larger groups are not compared but judged by SHINGLE_BITS.

    root is the smallest doc_id of the group; text_key is the MD5 of the text.
    Rows of one doc_id and different texts are documents apart. Wordless texts
    are all the same. Empty input: no rows.
    """
    small_batches(docs.sparkSession)
    wide = PRINTS + SHINGLE_WORDS
    cols = [f"p{k}" for k in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, prints, keys = wide_prints(texts(b.column(2)))
            values = [pa.array(digest, pa.binary()), *[pa.array(prints[:, k].view(np.int64)) for k in range(wide)], pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *values], ["doc_id", "text_key", "size", "digest", *cols, "bands"])
        trim()

    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    schema = "doc_id long, text_key string, size long, digest binary, " + ", ".join(f"{c} long" for c in cols) + ", bands array<long>"
    found = saved(own.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(run, schema), "prints")
    # a node is a sequence of words; its number tells nothing but that it is the same
    firsts = [F.min(F.struct("doc_id", "text_key", "size")).alias("x"), *[F.first(c).alias(c) for c in [*cols, "bands"]]]
    same = found.groupBy("digest").agg(*firsts).select("digest", "x.doc_id", "x.text_key", "x.size", *cols, "bands", F.xxhash64("digest").alias("node"))
    same = saved(same, "nodes")
    bucket_rows = max(bucket_rows, 2 << (PRINT_RADIUS + 1))  # more than the buckets hold whose masks could not shrink
    pairs = _candidates(same.select("node", *cols, "bands"), cols, parts(docs), bucket_rows, {-1: LOOSE_BITS} | ({} if group_texts is None else {-2: SHINGLE_BITS}))
    near = components(pairs.filter("kind = -1").select("u", "v")).withColumnRenamed("root", "near")
    of_group = saved(same.select("node", "doc_id", "text_key", "size").join(near, "node"), "near")
    share = F.greatest(F.count("*") / task_texts, F.sum("size") / TASK_BYTES)
    n_blocks = F.when(share <= 1, 1).otherwise(F.ceil(2 * share)).cast("int")
    if group_texts is not None:
        n_blocks = F.when(F.count("*") <= group_texts, n_blocks).otherwise(0)
    n_blocks = of_group.groupBy("near").agg(n_blocks.alias("n_blocks"))
    of_group = of_group.join(n_blocks, "near").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.greatest("n_blocks", F.lit(1))).cast("int"))
    of_group = saved(of_group, "groups")
    blocks = of_group.filter("n_blocks > 0").select("doc_id", "text_key", "near", "node", "block", "n_blocks")
    # most texts are in no group: only those that may be are shuffled
    held = may_match(own, blocks, ["doc_id", "text_key"]).filter("may").join(blocks, ["doc_id", "text_key"])
    # a text goes to the tasks of its block and each other one; a group of one block is one task
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).filter("n_blocks = 1 or other <> block")
    held = held.select("near", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "text")
    compared = held.repartition(parts(docs), "near", "i", "j").sortWithinPartitions("near", "i", "j", "node").mapInArrow(_exact_runs, "u long, v long")
    if group_texts is not None:
        large = of_group.filter("n_blocks = 0").select(F.col("node").alias("u"))
        compared = compared.union(pairs.filter("kind = -2").select("u", "v").join(large, "u", "left_semi"))
    roots = components(saved(compared, "links"))
    reps = same.select("digest", "node", F.col("doc_id").alias("first_doc")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = saved(reps.groupBy("root").agg(F.min("first_doc").alias("least")), "roots")
    reps = saved(reps.join(named, "root").select("digest", F.col("root").alias("group"), F.col("least").alias("root")), "reps")
    return found.select("doc_id", "text_key", "digest").join(reps, "digest").select("doc_id", "text_key", "group", "root")


def text_key(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group of copies (see :func:`alike`): that of the smallest doc_id.

    Rows of one doc_id and text are one document, of which one row stays; where
    a doc_id has several texts in a group, that of the least text_key. Rows
    without a doc_id can't be told apart and stay. Other columns may have any
    name and stay as they are. Empty input: no rows.
    """
    names = docs.columns
    told = saved(alike(docs.select("doc_id", "text")), "told")
    firsts = told.filter("doc_id = root").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    kept = saved(firsts.select(F.col("x.doc_id").alias("i"), F.col("x.text_key").alias("k")).distinct(), "kept")
    # what goes, or stands in several rows; all other rows stay where they are
    times = told.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.count("*").alias("n"))
    judged = saved(times.join(kept.withColumn("stays", F.lit(True)), ["i", "k"], "left").filter("stays is null or n > 1").select("i", "k"), "judged")
    own = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)]).alias("row"), F.col("doc_id").cast("long").alias("i"), text_key().alias("k"))
    own = may_match(own, judged, ["i", "k"])
    some = own.filter("may and i is not null").join(kept, ["i", "k"], "left_semi").dropDuplicates(["i", "k"])
    out = some.unionByName(own.filter("not may or i is null"))
    return out.select(*[F.col(f"row.c{n}").alias(c) for n, c in enumerate(names)])
