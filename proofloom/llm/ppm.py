"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ``ORDER`` preceding bytes. A byte is
coded in the longest context that training has seen; where the byte itself was
not seen there, an escape leads to the next shorter context, in which the bytes
already ruled out take no part (exclusion), and at last to all bytes that the
language never had, alike. The escape counts as often as a context has distinct
next bytes (method C). Probabilities of all bytes in a context sum to one, and
the statistics are frozen, so the negative log2 of their product is the exact
code length of a text; the language of the shortest code is predicted.

The trees are a classifier fitted on a bounded sample of labelled rows: for each
language the texts of least keyed hash, ``CUT`` characters of each at most, up to
``LANG_BYTES`` in all, or an equal share of ``SAMPLE_BYTES`` where there are many
languages; the ``MAX_LANGS`` languages with most training rows are learnt. So the
trees, which travel to the tasks, are bounded too, and every text is scored
whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, trim

ORDER = 4
CUT = 1 << 16
LANG_BYTES, SAMPLE_BYTES, MAX_LANGS = 512 << 10, 4 << 20, 256
#: Before a text stand line ends.
PAD = b"\n" * ORDER
#: Bytes of texts whose grams are in memory at once.
CHUNK = 2 << 20
LETTER = r"\p{L}"


def held_out(doc_id: Column | str) -> Column:
    """The remainder of crc32 over the id's decimal digits is 1; a null id is never held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(pieces: list[bytes]) -> np.ndarray:
    """The ORDER bytes before and the byte itself, as one number, of every byte of ``pieces`` after their first ORDER."""
    raw = b"".join(pieces)
    wide = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(wide[:8].view(np.uint64), (max(len(raw) - ORDER, 0),), (1,))
    g = eight.byteswap() >> np.uint64(8 * (7 - ORDER))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.cumsum(sizes)[:-1]
    keep = np.ones(len(g), bool)
    for k in range(ORDER):  # those that end in the next piece's context
        keep[first - ORDER + k] = False
    return g[keep]


class Tree:
    """A language's contexts and what follows them, by order, as sorted arrays; see :meth:`bits`."""

    def __init__(self, sample: list[bytes]):
        g = np.sort(grams([PAD + x for x in sample]))
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        keys, counts = {ORDER: g[new]}, {ORDER: np.diff(np.append(new, len(g))).astype(np.float64)}
        up: dict[int, np.ndarray] = {}
        for k in range(ORDER, 0, -1):
            keys[k - 1], up[k] = np.unique(keys[k] & np.uint64((1 << 8 * k) - 1), return_inverse=True)
            counts[k - 1] = np.bincount(up[k], weights=counts[k], minlength=len(keys[k - 1]))
        self.keys, self.symbol = keys, {k: np.log2(c) for k, c in counts.items()}
        self.contexts, self.enter, self.leave = {}, {}, {}
        #: Of a context's parent, without the bytes seen in the context: log2 of the total, and bits of an escape.
        self.total_up, self.leave_up = {}, {}
        kinds = {}
        for k in range(ORDER + 1):
            self.contexts[k], of = np.unique(keys[k] >> np.uint64(8), return_inverse=True)
            n, t = np.bincount(of, weights=counts[k]), np.bincount(of).astype(np.float64)
            self.enter[k], self.leave[k] = np.log2(n + t), np.log2(n + t) - np.log2(t)
            if k:
                parent = np.zeros(len(n), np.int64)
                parent[of] = kinds["of"][up[k]]
                rest_n = kinds["n"][parent] - np.bincount(of, weights=counts[k - 1][up[k]])
                rest_t = kinds["t"][parent] - t
                some = rest_t > 0  # else every byte of the parent is ruled out, and the escape costs nothing
                self.total_up[k] = np.log2(np.where(some, rest_n + rest_t, 1))
                self.leave_up[k] = self.total_up[k] - np.log2(np.where(some, rest_t, 1))
            kinds = {"of": of, "n": n, "t": t}
        self.never = np.log2(max(256 - len(keys[0]), 1))  # order 0 has each byte that the language has

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each of ``g`` after the bytes before it."""
        cost, done, inside = np.zeros(len(g)), np.zeros(len(g), bool), np.zeros(len(g), bool)
        below = np.zeros(len(g), np.int64)
        for k in range(ORDER, -1, -1):
            key = g & np.uint64((1 << 8 * (k + 1)) - 1)
            at, seen = _find(self.contexts[k], key >> np.uint64(8))
            sym, found = _find(self.keys[k], key)
            starts, goes_on = seen & ~inside, inside & ~done
            hit = (starts | goes_on) & found
            total = np.where(starts, self.enter[k][at], self.total_up[k + 1][below] if k < ORDER else 0.0)
            escape = np.where(starts, self.leave[k][at], self.leave_up[k + 1][below] if k < ORDER else 0.0)
            cost += np.where(hit, total - self.symbol[k][sym], np.where(starts | goes_on, escape, 0.0))
            done |= hit
            inside |= seen
            below = at
        return cost + np.where(done, 0.0, self.never)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table that is not empty, and whether it does."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def trees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", lang_bytes: int = LANG_BYTES, sample_bytes: int = SAMPLE_BYTES, max_langs: int = MAX_LANGS) -> dict[str, Tree]:
    """The tree of each language, from the documents that are not held out and have text and language."""
    own = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(doc_id)).select(
        F.col(lang).alias("lang"), F.substring(text, 1, CUT).alias("text"), F.xxhash64(F.lit("ppm"), doc_id, text).alias("u")
    )
    own = own.filter("text <> ''")
    sizes = own.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not sizes:
        return {}
    share = min(lang_bytes, sample_bytes // len(sizes))
    # twice the share is expected below the bound; what is too much goes in order of the hash
    bounds = [(r["lang"], int(min(1.0, 2.0 * share / r["bytes"] + 64.0 / r["n"]) * 2.0**63) - 1) for r in sizes]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")  # max_langs rows at most
    some = own.join(F.broadcast(bound), "lang").filter(F.col("u").bitwiseAND(F.lit((1 << 63) - 1)) <= F.col("bound"))
    texts_of: dict[str, list[bytes]] = {}
    taken: dict[str, int] = {}
    for name, _, t in sorted(some.groupBy("lang", "u").agg(F.min("text").alias("text")).collect()):
        raw = t.encode()
        if taken.get(name, 0) + len(raw) <= max(share, CUT * 4):
            texts_of.setdefault(name, []).append(raw)
            taken[name] = taken.get(name, 0) + len(raw)
    return {name: Tree(texts_of[name]) for name in sorted(texts_of)}


def _pieces(raws: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of about CHUNK bytes, 2^16 pieces at most: (document, its next bytes with the ORDER before them)."""
    docs, pieces, size = [], [], 0
    for d, raw in raws:
        raw = PAD + raw
        for at in range(0, max(len(raw) - ORDER, 1), CHUNK):
            docs.append(d)
            pieces.append(raw[at : at + CHUNK + ORDER])
            size += len(pieces[-1])
            if size >= CHUNK or len(docs) == 1 << 16:
                yield docs, pieces
                docs, pieces, size = [], [], 0
    if docs:
        yield docs, pieces


def lengths(models: list[Tree], raws: list[bytes]) -> np.ndarray:
    """Bits of each text under each model: an array of texts by models."""
    out = np.zeros((len(raws), len(models)))
    for docs, pieces in _pieces(enumerate(raws)):
        own = np.repeat(np.arange(len(pieces), dtype=np.uint64), [len(p) - ORDER for p in pieces])
        s = np.sort((grams(pieces) << np.uint64(16)) | own)  # equal grams side by side, each with its piece
        if not len(s):
            continue
        g = s >> np.uint64(16)
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        runs, piece, distinct = np.diff(np.append(new, len(g))), (s & np.uint64(65535)).astype(np.int64), g[new]
        for k, m in enumerate(models):
            np.add.at(out[:, k], docs, np.bincount(piece, weights=np.repeat(m.bits(distinct), runs), minlength=len(pieces)))
    return out


def _predicted(models: dict[str, Tree]):
    names, each = list(models), list(models.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                letters = part.column(3).to_numpy(zero_copy_only=False)
                pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if names and letters.any():
                    bits = lengths(each, [t if ok else b"" for t, ok in zip(texts(part.column(2)), letters)])
                    best = bits.argmin(1)  # of equal ones the first by name
                    post = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                    score = np.where(letters, np.clip(post, 0, 1), 0.0)
                    pred = [names[k] if ok else "und" for k, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
        trim()

    return run


def predicted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", models: dict[str, Tree] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    score is the predicted language's probability given the text, all languages
    being alike before. A prediction looks at the text alone. Null text, and text
    without a letter: ``und`` with score 0, and so for all texts where no row could
    be learnt from. Equal code lengths: the language first by name. Null lang: the
    row is not learnt from. Null doc_id: a training row. Repeated rows are answered
    each. Empty input: no rows. ``models``: trees fitted before, by :func:`trees`.
    """
    small_batches(docs.sparkSession)
    models = trees(docs, doc_id, text, lang) if models is None else models
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(LETTER), F.lit(False)).alias("letters"))
    return own.mapInArrow(_predicted(models), "doc_id long, held_out boolean, lang_pred string, score double")
