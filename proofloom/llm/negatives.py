"""Hard negatives by inner product, through one-dimensional distance keys.

A vector x of integers, with M the greatest squared length of all, becomes
(x, sqrt(M - |x|^2)), and an anchor q becomes (q, 0): then |q~ - x~|^2 is
|q|^2 + M - 2 q.x, so that higher products are nearer. Every row is keyed by its
nearest pivot and its distance from it, and stored in blocks sorted by (pivot,
distance). A row within radius r of an anchor lies, at each pivot, between the
anchor's distance less r and its distance plus r: a search asks for the blocks of
these key intervals, and widens r round by round until every wanted rank is
certified, which it is when its row is no further away than r. Rows already
scanned lie in the inner intervals and are passed over. Products are exact
integers; only the bounds are floating-point, and have slack.

An anchor searches twice: for the best rows of its own label (its positives), and
then for each positive for the best rows of other labels in a window of scores.
The windows of an anchor share one scan, which starts at the upper end of the
highest window and ends at the lower end of the lowest.

Anchors go in groups of neighbours, and a group's request for a block is one row.
Blocks and the groups that ask for them meet in tasks by (block, salt): a block of
a hot pivot is asked for by many groups and is then scanned in several tasks. A
task holds one block and one group at a time. What is shuffled is blocks times
salts and requests times a group's bytes; neither vectors nor blocks are ever
broadcast or collected. The driver sees the pivots, taken from a bounded sample
(``SAMPLE`` rows of least hash; every row is indexed), and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, saved, small_batches, trim

SAMPLE, PIVOTS = 4096, 32
BLOCK_ROWS, GROUP, SALT_GROUPS = 16384, 256, 64
POSITIVES, NEGATIVES = 5, 10
#: Share of the positive's score that a negative's may have, in hundredths.
LOW, HIGH = 30, 90
#: Larger components than this could make a product overflow.
LARGEST = 1 << 28
#: DuckDB SQL of :func:`mined` over ``embeddings``; products of whole numbers below 2^53 are exact there too.
ORACLE = """
WITH v AS (
  SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id a, b.id b, a.l = b.l same, list_inner_product(a.v, b.v)::BIGINT s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b p, s.b n, p.s ps, s.s ns FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a anchor_id, p positive_id, row_number() OVER (PARTITION BY a, p ORDER BY ns DESC, n)::INT rank, n negative_id, ps positive_score, ns negative_score
FROM n QUALIFY rank <= 10
"""
HITS = "anchor long, window int, score long, id long, place long"


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", relabel: bool = True) -> DataFrame:
    """(id, label, v): components as floor(256 x); without rows that take no part."""
    x = F.col(embedding)
    fit = ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(F.floor(e.cast("double") * 256).cast("double")) > LARGEST))
    lab = F.col(label).cast("long")
    if relabel:
        lab = F.when(F.col(vec_id) % 7 == 0, (lab + 1) % 10).otherwise(lab)
    return rows.filter(F.col(label).isNotNull() & F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(fit, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), lab.alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("int")).alias("v")
    )


def _matrix(lists: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(kind)
    out = np.zeros((len(sizes), dim), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in floating point where nothing can be lost."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def pivots_of(sample: np.ndarray, most: float, n: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """Centres of the augmented sample: every few rows to begin with, then means of what is nearest."""
    x = np.hstack([sample, np.sqrt(np.maximum(most - (sample**2).sum(1), 0))[:, None]])
    centres = np.unique(x[:: max(len(x) // n, 1)][:n], axis=0)
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        centres = np.array([x[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T, 0))


def _keyed(pivots: np.ndarray, dim: int, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(2), dim)
                d = _distances(np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]]), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "label", "v", "pivot", "d"])

    return run


def _blocks(dim: int, rows: int):
    """Sorted rows of a task to blocks of one pivot; ``place`` tells rows apart, those of the same id too."""
    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("wide", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("ds", pa.binary()), ("vs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(p: int, runs: list) -> pa.RecordBatch:
            nonlocal seq
            ids, labels, d, v = (np.concatenate(c) for c in zip(*runs))
            wide = next(w for w in (1, 2, 4) if w == 4 or (len(v) and np.abs(v).max() < 1 << (8 * w - 1)))
            seq += 1
            cols = [(part << 24) + seq, p, d[0], d[-1], len(ids), wide, ids.tobytes(), labels.tobytes(), d.tobytes(), v.astype(f"<i{wide}").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, schema.types)], schema=schema)

        pivot = None
        for b in batches:
            pv = b.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(pv[1:] != pv[:-1]) + 1).tolist(), len(pv)]
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4).to_numpy(), _matrix(b.column(2), dim, np.int32)]
            for i, j in zip(cuts, cuts[1:]):
                while i < j:
                    if held and (pv[i] != pivot or size == rows):
                        yield block(pivot, held)
                        held, size = [], 0
                    pivot, k = int(pv[i]), min(j, i + rows - size)
                    held.append([c[i:k] for c in cols])
                    size += k - i
                    i = k
        if held:
            yield block(pivot, held)
        trim()

    return run


def _grouped(dim: int, pivots: np.ndarray, most: float, group: int):
    """Anchors of a task, in key order, to groups: ids, places, labels, vectors and distances from all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def out(rows: list) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            ids, places, labels, v = (np.concatenate(c) for c in zip(*rows))
            x = v.astype(np.float64)
            d = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
            q = np.abs(x).max(initial=0)
            wide = next(w for w in (1, 2, 4) if w == 4 or q < 1 << (8 * w - 1))
            cols = [(part << 24) + seq, len(ids), wide, ids.tobytes(), places.tobytes(), labels.tobytes(), d.tobytes(), v.astype(f"<i{wide}").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], ["grp", "n", "wide", "ids", "places", "labels", "ds", "vs"])

        for b in batches:
            for at in range(0, b.num_rows, group):
                p = b.slice(at, group)
                v = np.array([np.frombuffer(x, "<i4") for x in p.column(3).to_pylist()], np.int32).reshape(p.num_rows, dim)
                held.append([p.column(0).to_numpy(), p.column(1).to_numpy(), p.column(2).to_numpy(), v])
                if sum(len(h[0]) for h in held) >= group:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return run


ANCHORS = "id long, place long, label long, v binary"
GROUPS = "grp long, n long, wide long, ids binary, places binary, labels binary, ds binary, vs binary"


def _anchors(dim: int, every: int):
    """The anchors among the rows of blocks, with their places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n, wide, ids, labels, vs in zip(*(c.to_pylist() for c in b.columns)):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                at = np.flatnonzero(ids % every == 0)
                v = np.frombuffer(vs, f"<i{wide}").reshape(n, dim)[at].astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array((block << 20) + at), pa.array(labels[at]), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "place", "label", "v"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key intervals, at each pivot, in which a group's searches have something to scan: a row for each side of the anchors."""
    for b in batches:
        for grp, n, ds, todo in zip(*(b.column(c).to_pylist() for c in ("grp", "n", "ds", "todo"))):
            d = np.frombuffer(ds, np.float64).reshape(n, -1)
            at, was, now, near = _todo(todo)
            q = d[at]
            below = (np.maximum(q - now[:, None], near[:, None] - q), q - was[:, None])
            above = (np.maximum(q + np.maximum(was, 0)[:, None], near[:, None] - q), q + now[:, None])
            for lo, hi in (below, above):
                ok = lo <= hi
                lo, hi = np.where(ok, lo, np.inf).min(0), np.where(ok, hi, -np.inf).max(0)
                p = np.flatnonzero(lo <= hi)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), grp)), pa.array(p.astype(np.int32)), pa.array(lo[p]), pa.array(hi[p])], ["grp", "pivot", "a", "b"])


def _todo(todo: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the searches still open: number of the anchor in its group, radius scanned (below 0: none), radius to scan, least distance wanted."""
    x = np.array([(t["at"], t["was"], t["now"], t["near"]) for t in todo], np.float64).reshape(len(todo), 4)
    return x[:, 0].astype(np.int64), x[:, 1], x[:, 2], x[:, 3]


def _scan(dim: int, k: int, same: bool):
    """Rows of a task: a block, then the groups that ask for it. Emits the best ``k`` of the block for each window of each anchor.

    A request's ``todo`` has, for each open anchor, its windows with the least score still of use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for r in b.to_pylist():
                if r["ask"] == 0:
                    ids, labels, ds = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("labels", np.int64), ("ds", np.float64)))
                    block = (r["block"] << 20) + np.arange(r["n"]), ids, labels, ds, np.frombuffer(r["vs"], f"<i{r['wide']}").reshape(r["n"], dim), r["pivot"]
                    continue
                out = _hits(block, r, dim, k, same)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["anchor", "window", "score", "id", "place"])
        trim()

    return run


def _hits(block: tuple, r: dict, dim: int, k: int, same: bool) -> list[np.ndarray]:
    places, ids, labels, ds, v, pivot = block
    own_places, own_labels = np.frombuffer(r["places"], np.int64), np.frombuffer(r["labels"], np.int64)
    q = np.frombuffer(r["ds"], np.float64).reshape(r["n"], -1)[:, pivot]
    vs = np.frombuffer(r["vs"], f"<i{r['wide']}").reshape(r["n"], dim)
    at, was, now, near = _todo(r["todo"])
    first = np.searchsorted(ds, np.maximum(q[at] - now, near - q[at]), "left")
    last = np.searchsorted(ds, q[at] + now, "right")
    found: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    some = np.flatnonzero(first < last)
    if not len(some):
        return [np.concatenate(c) for c in found]
    i, j = int(first[some].min()), int(last[some].max())
    scores = _products(vs[at[some]], v[i:j])
    for row, s in zip(scores, some.tolist()):
        a, b = int(first[s]), int(last[s])
        d = np.abs(ds[a:b] - q[at[s]])
        kin = labels[a:b] == own_labels[at[s]]
        ok = (d > was[s]) & (kin if same else ~kin) & (places[a:b] != own_places[at[s]])
        x = row[a - i : b - i]
        for w in r["todo"][s]["windows"]:
            c = np.flatnonzero(ok & (x <= w["high"]) & (x >= w["low"]))
            if len(c) > 4 * k:  # no row below the k-th best can count, those level with it can
                c = c[x[c] >= np.partition(x[c], len(c) - k)[len(c) - k]]
            c = c[np.lexsort((places[a:b][c], ids[a:b][c], -x[c]))[:k]]
            for col, value in zip(found, (np.full(len(c), own_places[at[s]]), np.full(len(c), w["window"], np.int32), x[c], ids[a:b][c], places[a:b][c])):
                col.append(value)
    return [np.concatenate(c) for c in found]


class Index:
    """Rows stored by (pivot, distance); see the module."""

    def __init__(self, rows: DataFrame, n_pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, group: int = GROUP):
        """``rows``: (id, label, v) of :func:`whole_vectors`."""
        spark = rows.sparkSession
        small_batches(spark)
        own = rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))
        self.n, most, dim = own.agg(F.count("*"), F.max("sq"), F.max(F.size("v"))).first()
        self.most, self.dim, self.group = float(most or 0), int(dim or 0), group
        if not self.n:
            return
        # the share that holds about SAMPLE rows, and of repeated rows one
        u = F.xxhash64(F.lit("pivot"), "id", "v")
        some = rows.filter(F.pmod(u, F.lit(self.n)) < 2 * SAMPLE).groupBy(u.alias("u")).agg(F.first("v").alias("v")).orderBy("u").limit(SAMPLE).collect()
        sample = np.zeros((len(some), self.dim))
        for k, r in enumerate(some):
            sample[k, : len(r["v"])] = r["v"]
        if not len(sample):
            sample = np.zeros((1, self.dim))
        self.pivots = pivots_of(sample, self.most, n_pivots)
        x = np.hstack([sample, np.sqrt(np.maximum(self.most - (sample**2).sum(1), 0))[:, None]])[:512]
        d = _distances(np.hstack([x[:, :-1], np.zeros((len(x), 1))]), np.hstack([sample, np.sqrt(np.maximum(self.most - (sample**2).sum(1), 0))[:, None]]))
        #: First radius of a search: in the sample, half the anchors would have a few rows within it.
        self.first = float(np.median(np.partition(d, min(3, d.shape[1] - 1), axis=1)[:, min(3, d.shape[1] - 1)])) + 1.0
        self.far = 2 * np.sqrt(self.most) + 1.0  # no row is further from an anchor
        self.step = max((self.far - self.first) / 16, 1e-3)
        n = parts(rows)
        keyed = rows.mapInArrow(_keyed(self.pivots, self.dim, self.most), "id long, label long, v array<int>, pivot int, d double")
        order = ["pivot", "d", "id", F.monotonically_increasing_id()]
        keyed = keyed.repartitionByRange(n, *order).sortWithinPartitions("pivot", "d", "id")
        self.blocks = saved(keyed.mapInArrow(_blocks(self.dim, block_rows), "block long, pivot int, lo double, hi double, n int, wide int, ids binary, labels binary, ds binary, vs binary"), "negatives-blocks")

    def anchors(self, every: int) -> DataFrame:
        """Groups of the anchors: rows whose id is divisible by ``every``, neighbours together."""
        own = self.blocks.select("block", "n", "wide", "ids", "labels", "vs").mapInArrow(_anchors(self.dim, every), ANCHORS)
        return saved(own.repartitionByRange(parts(self.blocks), "place").sortWithinPartitions("place").mapInArrow(_grouped(self.dim, self.pivots, self.most, self.group), GROUPS), "negatives-anchors")

    def search(self, groups: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, window, score, id, place, rank): the ``k`` best of each window, all if fewer.

        windows: (anchor: its place, grp, at: its number in the group, sq: its
        squared length, window, low, high: bounds of the score, inclusive).
        """
        far, slack = self.far, 1e-6 * (1 + self.far)
        dist = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("sq") + self.most - 2.0 * score))
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "place")
        hits = None
        searches = windows.withColumns({"near": F.greatest(F.lit(0.0), dist(F.col("high")) - slack), "until": F.least(F.lit(far), dist(F.col("low")) + slack)})
        # of an anchor: where its highest window begins, and how far its lowest goes
        state = searches.groupBy("anchor", "grp", "at").agg(F.min("near").alias("near"), F.max("until").alias("until"))
        state = state.withColumns({"was": F.lit(-1.0), "now": F.least("until", F.greatest(F.lit(self.first), F.col("near") + self.step))})
        state = saved(state, "negatives-state")
        salts = max(groups.count() // SALT_GROUPS, 1)
        r = 0
        while not state.isEmpty():
            r += 1
            open_ = searches.join(state.select("anchor", "was", "now", F.col("near").alias("begin")), "anchor")
            todo = open_.groupBy("grp", "at").agg(
                F.first("was").alias("was"), F.first("now").alias("now"), F.first("begin").alias("near"), F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("windows")
            )  # a row for each open anchor, of a few windows
            todo = todo.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("at", "was", "now", "near", "windows"))).alias("todo"))
            asking = saved(groups.join(todo, "grp"), "negatives-asking")
            spans = asking.select("grp", "n", "ds", "todo").mapInArrow(_asked, "grp long, pivot int, a double, b double")
            directory = self.blocks.select("block", "pivot", "lo", "hi")
            wanted = spans.join(directory, "pivot").filter("lo <= b and hi >= a").select("grp", "block").distinct()
            wanted = saved(wanted.withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(salts))), "negatives-wanted")
            null = lambda schema, names: [F.lit(None).cast(schema[c].dataType).alias(c) for c in names]
            cols = ["n", "wide", "ids", "labels", "ds", "vs"]
            left = self.blocks.join(wanted.select("block", "salt").distinct(), "block").select("block", "salt", F.lit(0).alias("ask"), "pivot", *(F.col(c).cast(groups.schema[c].dataType) for c in cols), *null(asking.schema, ["grp", "places", "todo"]))
            right = asking.join(wanted, "grp").select("block", "salt", F.lit(1).alias("ask"), *null(self.blocks.schema, ["pivot"]), *cols, "grp", "places", "todo")
            met = left.union(right).repartition(parts(groups), "block", "salt").sortWithinPartitions("block", "salt", "ask", "grp")
            more = met.mapInArrow(_scan(self.dim, k, same), HITS)
            more = more if hits is None else hits.union(more)
            hits = saved(more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "negatives-hits")
            # certified: the k-th row of every window lies within the radius, or nothing lies beyond it
            held = hits.groupBy("anchor", "window").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
            need = searches.join(held, ["anchor", "window"], "left").withColumn("reach", F.when(F.col("found") >= k, F.least("until", dist(F.col("worst")) + slack)).otherwise(F.col("until")))
            need = need.groupBy("anchor").agg(F.max("reach").alias("reach"), F.max((F.coalesce("found", F.lit(0)) < k).cast("int")).alias("short"))
            state = state.join(need, "anchor").filter("reach > now").withColumn("was", F.col("now"))
            # known: straight to the bound; else wider by twice as much as before
            state = state.withColumn("now", F.when(F.col("short") == 0, F.col("reach")).otherwise(F.least("until", F.col("was") + self.step * 2.0**r)))
            state = saved(state.select("anchor", "grp", "at", "near", "until", "was", "now"), "negatives-state")
        if hits is None:
            hits = groups.sparkSession.createDataFrame([], HITS)
        return hits.withColumn("rank", F.row_number().over(order))


def _members(dim: int):
    """(anchor, grp, at, id, sq) of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, n, wide, ids, places, vs in zip(*(b.column(c).to_pylist() for c in ("grp", "n", "wide", "ids", "places", "vs"))):
                v = np.frombuffer(vs, f"<i{wide}").reshape(n, dim).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(places, np.int64)), pa.array(np.full(n, grp)), pa.array(np.arange(n)), pa.array(np.frombuffer(ids, np.int64)), pa.array((v**2).sum(1))], ["anchor", "grp", "at", "id", "sq"])

    return run


def mined(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, relabel: bool = True, **sizes: int) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; positives the first
    ``positives`` other rows of an anchor's label; negatives of a pair the first
    ``negatives`` rows of other labels whose score is LOW to HIGH hundredths of the
    positive's. Higher scores come first, ties by smaller id; all if there are
    fewer. Null label, vector, id or component, and components that are not finite
    or over 2^20 in size: the row takes no part. Vectors of unequal length: the
    shorter one ends in zeros. Empty vectors score zero. A repeated row is a row of
    its own: as an anchor it has results of its own, for another anchor both count.
    Empty table, or no anchor: no rows.
    """
    spark = rows.sparkSession
    index = Index(whole_vectors(rows, vec_id, embedding, label, relabel), **sizes)
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not index.n:
        return none
    groups = index.anchors(every)
    members = saved(groups.select("grp", "n", "wide", "ids", "places", "vs").mapInArrow(_members(index.dim), "anchor long, grp long, at long, id long, sq double"), "negatives-members")
    bound = int(index.most) + 1
    windows = members.select("anchor", "grp", "at", "sq", F.lit(0).alias("window"), F.lit(-bound).cast("long").alias("low"), F.lit(bound).cast("long").alias("high"))
    good = saved(index.search(groups, windows, positives, same=True).select("anchor", F.col("rank").alias("window"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "negatives-positives")
    bounds = F.expr(f"({LOW} * positive_score + 99) div 100").alias("low"), F.expr(f"({HIGH} * positive_score) div 100").alias("high")
    windows = saved(good.filter("positive_score >= 0").join(members, "anchor").select("anchor", "grp", "at", "sq", "window", *bounds), "negatives-windows")
    bad = index.search(groups, windows, negatives, same=False)
    return (
        bad.join(good, ["anchor", "window"]).join(members.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
