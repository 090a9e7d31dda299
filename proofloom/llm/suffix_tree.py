"""Language-model scores by a probabilistic suffix tree over the bytes of the token sequence.

A text is its words, A-Z lowered, each with one space after it, and a newline,
which is the end token; no word holds either byte, so texts and byte sequences
match one to one. A state is a context of up to ``DEPTH`` bytes. Those of up to
two bytes are retained as they are; a longer one is if its next-byte distribution
diverges from its parent's (the longest proper suffix) by ``min_gain`` nats over
all its occurrences, or if a longer retained context needs it. Each retained state's distribution is smoothed towards its
parent's by the number of distinct next bytes it has seen; a byte is scored by
the longest retained suffix of what stands before it. So the tree spells the
next token with a probability, whether training had the token or not, and a
share of ``OWN`` goes to the token's own relative frequency, which tells more
than the tree where training is short: P(t) = OWN * c(t) / N + (1 - OWN) * tree(t).

Work is by blocks of documents, as a task reads them. A block asks for each of its
distinct words and (DEPTH+1)-byte grams once, the counts are summed over all
blocks, contexts are split over tasks by their last two bytes, or three where
one pair has over 1/``PAIRS`` of all grams, and the answers return to the block
by joins. No vocabulary, gram table or model is broadcast or collected but the
counts of single bytes after single bytes, 65,536 at most, and of those after
the split pairs, fewer than 256 * ``PAIRS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, saved, small_batches, texts, trim, words

DEPTH = 5
END = b"\n"
BLOCK = 16 << 20
OWN = 0.2
PAIRS = 256
#: A task holds all its grams, and reads its blocks one by one: what is beyond the session's partitions gets more of them.
TASK_GRAMS, TASK_BLOCKS = 2 << 20, 8
LN10 = float(np.log(10))
CHUNK = 2 << 20  # bytes whose grams are in memory at once


def held_out(doc_id: int | None) -> bool:
    """The remainder of crc32 over the id's decimal digits is 2; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK bytes: each document's byte sequence, compressed together."""
    part, seq = TaskContext.get().partitionId(), 0
    ids, lines, size = [], [], 0
    vocab: set[bytes] = set()

    def flush() -> pa.RecordBatch:
        block = (part << 24) + seq
        squeeze = zstandard.ZstdCompressor(level=3).compress
        out = pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, lines))], pa.list_(pa.int64())), pa.array([squeeze(b"".join(lines))], pa.binary()), pa.array([squeeze(b" ".join(sorted(vocab)))], pa.binary())],
            ["block", "ids", "sizes", "blob", "vocab"],
        )
        vocab.clear()
        trim()
        return out

    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
            ids.append(d)
            w = words(t)
            vocab.update(w)
            w.append(END)
            lines.append(b" ".join(w))
            size += len(lines[-1])
            if size >= BLOCK:
                yield flush()
                seq, ids, lines, size = seq + 1, [], [], 0
    if ids:
        yield flush()


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK bytes, 65,536 documents at most."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, side="right"))
        j = min(max(j, i + 1), i + (1 << 16), len(sizes))
        yield i, j
        i = j


def _grams(lines: list[bytes]) -> np.ndarray:
    """DEPTH+1 bytes up to each byte of each document, in order; before a document stand ends."""
    pad = END * DEPTH
    raw = b"".join(x for line in lines for x in (pad, line))
    n = len(raw) - DEPTH
    wide = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(wide[:8].view(np.uint64), (n,), (1,))
    g = eight.byteswap() >> np.uint64(8 * (7 - DEPTH))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + DEPTH
    first = np.cumsum(sizes)[:-1]
    keep = np.ones(n, bool)
    for k in range(DEPTH):  # those that end in the next document's pad
        keep[first - DEPTH + k] = False
    return g[keep]


def _counts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    s = np.sort(g)
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


class _Block:
    """A block's documents, of which only a run is in pieces at a time."""

    def __init__(self, ids: list, sizes: list, blob: bytes, vocab: bytes):
        self.raw = zstandard.ZstdDecompressor().decompress(blob)
        self.vocab = zstandard.ZstdDecompressor().decompress(vocab).split()  # distinct words in order
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.held_out = np.array([held_out(x) for x in ids], bool)

    def runs(self) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first document, past the last, byte sequences) of each run."""
        for i, j in _parts(self.sizes):
            yield i, j, [self.raw[b - n : b] for b, n in zip(self.ends[i:j].tolist(), self.sizes[i:j].tolist())]


def _tokens(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, code, length) of each token of some byte sequences in order, and the distinct tokens by code; the end is empty."""
    raw = b"".join(lines).replace(END, b" ")
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1  # every token stands before one space
    offsets = np.append(0, ends).astype(np.int32)
    d = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    codes, vocab = d.indices.to_numpy(), [w[:-1] for w in d.dictionary.to_pylist()]
    return np.searchsorted(np.cumsum([len(x) for x in lines]), ends), codes, np.diff(offsets), vocab


def _block_words(own: _Block, block: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """Batches of (block, number, word, count in training documents) of a block's distinct words in order."""
    place = {w: k for k, w in enumerate(own.vocab)}
    place[b""] = len(place)
    train = np.zeros(len(place), np.int64)
    for i, j, lines in own.runs():
        doc, codes, _, vocab = _tokens(lines)
        at = np.fromiter(map(place.__getitem__, vocab), np.int64, len(vocab))
        train[at] += np.bincount(codes, weights=~own.held_out[i:j][doc], minlength=len(vocab)).astype(np.int64)
    for at in range(0, len(own.vocab), 1 << 15):
        v = own.vocab[at : at + (1 << 15)]
        yield pa.array(np.full(len(v), block)), pa.array(np.arange(at, at + len(v), dtype=np.int32)), pa.array(v, pa.binary()).cast(pa.string()), pa.array(train[at : at + len(v)])


def _block_grams(own: _Block) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct grams in order, and their counts in training documents."""
    u, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i, j, lines in own.runs():
        for held in (False, True):
            some = [x for x, o in zip(lines, own.held_out[i:j]) if o == held]
            if not some:
                continue
            more, n = _counts(_grams(some))
            at = np.searchsorted(u, more)
            known = at < len(u)
            known[known] = u[at[known]] == more[known]
            if not held:
                c[at[known]] += n[known]
            new = ~known
            u, c = np.insert(u, at[new], more[new]), np.insert(c, at[new], 0 if held else n[new])
    return u, c


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block asks for: its distinct words, numbered in order, and grams, with their counts in training documents."""
    schema = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("word", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])
    for b in batches:
        for block, *packed in zip(*(c.to_pylist() for c in b.columns)):
            own = _Block(*packed)
            yield from (pa.RecordBatch.from_arrays([*x, pa.nulls(len(x[0]), pa.int64()), c], schema=schema) for *x, c in _block_words(own, block))
            trim()
            u, c = _block_grams(own)
            del own
            trim()
            for at in range(0, len(u), 1 << 15):
                n = len(u[at : at + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(u[at : at + n].astype(np.int64)), pa.array(c[at : at + n])], schema=schema)


def _levels(grams: np.ndarray, c: np.ndarray, pairs: np.ndarray, min_gain: float, hot: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """log10 P of the last byte of each gram.

    pairs: 256 x 256 counts over the corpus. ``grams`` hold all grams of their
    two-byte contexts, or for the contexts in ``hot``, which have the counts of
    the 256 next bytes over the corpus, all of their three-byte contexts.
    """
    single = pairs.sum(0)
    p0 = (single + 1) / (single.sum() + 256)
    total, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
    seen = total > 0
    p1 = np.where(seen, (pairs + kinds * p0) / np.where(seen, total + kinds, 1), p0)
    # keys[k]: distinct (k context bytes, next byte); up[k]: where its suffix stands in keys[k-1]
    keys, counts, up = {DEPTH: grams}, {DEPTH: c.astype(np.float64)}, {}
    for k in range(DEPTH, 2, -1):
        short = keys[k] & ((1 << 8 * k) - 1)
        keys[k - 1], up[k] = np.unique(short, return_inverse=True)
        counts[k - 1] = np.bincount(up[k], weights=counts[k], minlength=len(keys[k - 1]))
    p, need, ctx_of, ctx_up = {}, {}, {}, {}
    mix: dict[int, np.ndarray] = {}
    n_of, t_of = {}, {}
    for k in range(2, DEPTH + 1):
        ctx, ctx_of[k] = np.unique(keys[k] >> 8, return_inverse=True)
        n_of[k] = np.bincount(ctx_of[k], weights=counts[k], minlength=len(ctx))
        t_of[k] = np.bincount(ctx_of[k], weights=counts[k] > 0, minlength=len(ctx))
        if k == 2:
            for pair, nexts in (hot or {}).items():
                at = np.searchsorted(ctx, pair)
                if at < len(ctx) and ctx[at] == pair:
                    own = ctx_of[2] == at
                    counts[2][own] = nexts[keys[2][own] & 255]
                    n_of[2][at], t_of[2][at] = nexts.sum(), (nexts > 0).sum()
        else:
            ctx_up[k] = np.zeros(len(ctx), np.int64)
            ctx_up[k][ctx_of[k]] = ctx_of[k - 1][up[k]]
    # the divergence test is against the parent with all shorter contexts in place
    parent = {2: p1[(keys[2] >> 8) & 255, keys[2] & 255]}
    for k in range(2, DEPTH + 1):
        n, t = n_of[k][ctx_of[k]], t_of[k][ctx_of[k]]
        ml = np.divide(counts[k], n, out=np.zeros_like(counts[k]), where=n > 0)
        mix[k] = np.where(n > 0, (counts[k] + t * parent[k]) / np.where(n > 0, n + t, 1), parent[k])
        gain = np.bincount(ctx_of[k], weights=np.where(counts[k] > 0, counts[k] * np.log(np.where(ml > 0, ml, 1) / parent[k]), 0), minlength=len(n_of[k]))
        need[k] = (gain >= min_gain) | ((k == 2) & (n_of[k] > 0))
        if k < DEPTH:
            parent[k + 1] = mix[k][up[k + 1]]
    for k in range(DEPTH, 2, -1):  # a retained context keeps its suffixes
        need[k - 1][ctx_up[k][need[k]]] = True
    p[1] = None
    cur = p1[(keys[2] >> 8) & 255, keys[2] & 255]
    for k in range(2, DEPTH + 1):
        n, t = n_of[k][ctx_of[k]], t_of[k][ctx_of[k]]
        cur = np.where(need[k][ctx_of[k]], (counts[k] + t * cur) / np.where(n > 0, n + t, 1), cur)
        if k < DEPTH:
            cur = cur[up[k + 1]]
    return np.log10(cur)


def _answer(pairs: np.ndarray, min_gain: float, hot: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not rows:
            return
        g, c = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(g)
        g, c = g[order], c[order]
        p = _levels(g, c, pairs, min_gain, hot)
        for at in range(0, len(g), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(g[at : at + (1 << 16)]), pa.array(p[at : at + (1 << 16)])], ["gram", "x"])

    return run


def _bundled(kind: int):
    """Reads rows (block, number or gram, value); emits a compressed bundle of a task's rows for each block: differences of the sorted keys, then values."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
    value = "<f4" if kind else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            block, key, x = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((key, block))
            block, key, x = block[order], key[order], x[order]
            new = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
            squeeze = zstandard.ZstdCompressor(level=1).compress
            rows = [(int(block[i]), kind, j - i, squeeze(np.diff(key[i:j], prepend=0).tobytes() + x[i:j].astype(value).tobytes())) for i, j in zip(new, [*new[1:], len(block)])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().astype(np.float64)))
                size += b.num_rows
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        trim()

    return run


def _unbundled(told: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, values) of all bundles of a kind."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, n, blob in zip(*(told.column(c) for c in ("kind", "n", "blob"))):
        if k.as_py() == kind:
            raw, n = zstandard.ZstdDecompressor().decompress(blob.as_py()), n.as_py()
            keys.append(np.cumsum(np.frombuffer(raw, "<i8", n)))
            values.append(np.frombuffer(raw, "<f4" if kind else "<f8", n, 8 * n).astype(np.float64))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    return key[order], value[order]


def _spelt(g: np.ndarray, lengths: np.ndarray, gram: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """log10 P of each token, of ``lengths`` bytes, from the grams of all bytes; ``gram`` is sorted, ``logp`` beside it."""
    out, ends = np.zeros(len(lengths)), np.cumsum(lengths)
    for i in range(0, len(lengths), 1 << 16):  # a gram and the number of its token make one number, which sorts quickly
        j = min(i + (1 << 16), len(lengths))
        own = np.repeat(np.arange(j - i, dtype=np.uint64), lengths[i:j])
        s = np.sort((g[ends[i] - lengths[i] : ends[j - 1]] << np.uint64(16)) | own)
        key = (s >> np.uint64(16)).astype(np.int64)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        value = np.repeat(logp[np.searchsorted(gram, key[new])], np.diff(np.append(new, len(key))))
        out[i:j] = np.bincount((s & np.uint64(65535)).astype(np.int64), weights=value, minlength=j - i)
    return out


def _scored(n_train: int, v: int, ends: int):
    per = np.log10(n_train + v + 1)

    def run(packed: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not packed.num_rows:
            return schema.empty_table()
        ids, *rest = (packed.column(c)[0].as_py() for c in ("ids", "sizes", "blob", "vocab"))
        own = _Block(ids, *rest)
        counts = _unbundled(told, 0)[1]
        gram, logp = _unbundled(told, 1)
        place = {w: k for k, w in enumerate(own.vocab)}
        place[b""] = len(counts)
        counts = np.append(counts, ends)
        gain = np.log10(counts + 1)
        with np.errstate(divide="ignore"):
            own_log = np.log(counts * OWN / max(n_train, 1))
        rest = np.log(1 - OWN) if n_train else 0.0
        n, known, base, score = (np.zeros(len(ids), t) for t in (np.int64, np.int64, np.float64, np.float64))
        for a, b, lines in own.runs():
            doc, codes, lengths, vocab = _tokens(lines)
            at = np.fromiter(map(place.__getitem__, vocab), np.int64, len(vocab))[codes]
            n[a:b] = np.bincount(doc, minlength=b - a)
            base[a:b] = np.bincount(doc, weights=gain[at], minlength=b - a)
            known[a:b] = np.bincount(doc, weights=counts[at] > 0, minlength=b - a)
            spelt = _spelt(_grams(lines), lengths, gram, logp) * LN10
            score[a:b] = np.bincount(doc, weights=np.logaddexp(own_log[at], rest + spelt), minlength=b - a) / LN10
        base -= n * per
        del place, told, gram, logp, counts
        trim()
        return pa.table([pa.array(ids, pa.int64()), pa.array(own.held_out), pa.array(n), pa.array(known), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(base), pa.array(score)], schema=schema)

    return run


def _hot(after: DataFrame) -> DataFrame:
    """The two-byte contexts with over 1/PAIRS of all grams."""
    each = after.groupBy(F.shiftright("three", 8).alias("pair")).agg(F.sum("n").alias("n"))
    return each.join(F.broadcast(after.agg(F.sum("n").alias("of"))), F.col("n") * PAIRS > F.col("of")).select("pair")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_gain: float = 4.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the tree's log10 probability of the whole token sequence, learnt
    from the documents that are not held out. Null text: the empty text, whose
    only token is the end. Null doc_id: a training document. Repeated rows are
    scored and counted each. No training documents: uniform bytes. Empty input:
    no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = saved(own.mapInArrow(_packed, "block long, ids array<long>, sizes array<long>, blob binary, vocab binary"), "blocks")
    asked = saved(blocks.mapInArrow(_asked, "block long, i int, word string, gram long, c long"), "asked")
    w, g = asked.filter("word is not null"), asked.filter("gram is not null")
    by_word = Window.partitionBy("word")
    counted = w.select("block", "i", F.sum("c").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("block")) == 1).alias("once"))
    counted = saved(counted, "words")
    n_words, v_words = counted.filter("once").agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    totals = saved(g.groupBy("gram").agg(F.sum("c").alias("c")), "grams")
    after = saved(totals.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("three")).agg(F.sum("c").alias("c"), F.count("*").alias("n")), "after")  # what follows each pair
    pairs = np.zeros((256, 256))
    for pair, c in after.groupBy(F.col("three").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("c")).collect():  # 65,536 rows at most
        pairs[pair >> 8, pair & 255] = c
    hot = {r[0]: np.zeros(256) for r in _hot(after).collect()}
    for three, c in after.filter(F.shiftright("three", 8).isin(list(hot))).select("three", "c").collect():
        hot[three >> 8][three & 255] = c
    ends = int(pairs[:, 10].sum())  # one end for each training document
    n_train, v = (n_words or 0) + ends, (v_words or 0) + (ends > 0)
    pair, three = (F.shiftright("gram", 8).bitwiseAND(F.lit(m)) for m in (0xFFFF, 0xFFFFFF))
    dealt = F.when(pair.isin(list(hot)), three).otherwise(-1 - pair)
    n_grams = after.agg(F.sum("n")).first()[0] or 0
    model = totals.repartition(max(parts(docs), n_grams // TASK_GRAMS + 1), dealt).mapInArrow(_answer(pairs, min_gain, hot), "gram long, x double")
    bundle = "block long, kind int, n long, blob binary"
    told = counted.select("block", "i", F.col("c").cast("double").alias("x")).mapInArrow(_bundled(0), bundle)
    told = told.union(g.select("block", "gram").join(model, "gram").select("block", "gram", "x").mapInArrow(_bundled(1), bundle))
    n = blocks.count() // TASK_BLOCKS + 1
    if n > parts(docs):
        blocks, told = blocks.repartition(n, "block"), told.repartition(n, "block")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored(n_train, v, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
