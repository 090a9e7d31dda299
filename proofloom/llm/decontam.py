"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Alignment scores match 2, other 1 off, gap 1 off. A document holds a test item
of n words if its best local alignment reaches ``least`` of the item's full 2n,
and LEAST_RAW or all of 2n at any rate: a few words in common are chance.

Seeds are pairs of an item's words at distance 1 or 2, which meet in a document
at distance 1 or 2. Between two neighbouring matches of an alignment that are no
seed, at least two points are lost; an alignment of s points with m matches and
g points lost has 2m - g >= s, so m - 1 - g/2 >= s/2 - 1 of its neighbouring
matches are seeds. Half of that many pairs of an item, those that the documents
have most often, are therefore not looked for; the rarer ones still show every
alignment, whatever the edits, as s/2 - 1 less the dropped ones within the
longest stretch that s points can span. Rarity changes the work, never a result.

Items go to the tasks in slices of SLICE_BYTES of text as NumPy arrays: at most
20 times that, for items of one-letter words, and 7 times for common text. A
larger set of items means more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

LEAST_WORDS = 4
SLICE_BYTES = 8 << 20
LEAST_SCORE = 0.5
LEAST_RAW = 12
#: A-Z lowered; digits, a-z and all beyond ASCII are word characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bits of a place in a document, and of the number of an item in its slice, in a sort key.
_PLACE, _ITEM = 28, 21
#: Hits that are looked at together.
_HITS = 1 << 20
#: Texts that are searched together: their numbers take the bits that place and item leave.
TEXTS = 1 << 13


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... start + count - 1 of each, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Items:
    """A slice of the test items. Words are known by their place in the sorted array of their hashes, from 1."""

    def __init__(self, rows: list[tuple[int, bytes]], least: float):
        own = [(i, w) for i, t in rows if len(w := plain_words(t)) >= LEAST_WORDS]
        self.item_ids = [i for i, _ in own]
        sizes = np.array([len(w) for _, w in own], np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        hashes = _hashes([x for _, w in own for x in w])
        self.vocab = np.unique(hashes)
        self.words = (np.searchsorted(self.vocab, hashes) + 1).astype(np.int32)
        self.least = np.maximum(2 * sizes * least, np.minimum(2 * sizes, LEAST_RAW))
        points = np.ceil(self.least).astype(np.int64)
        self.span = 3 * sizes - points  # words of a document that an alignment can cover
        need = np.maximum(1, (points - 1) // 2)  # seeds at least: points / 2 - 1, rounded up
        self.wanted = np.maximum(1, need // 2)
        self.dropped = need - self.wanted
        self.item = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        keys, items = zip(*(self._pairs(self.words, self.item, d) for d in (1, 2))) if len(own) else ([np.zeros(0, np.int64)], [np.zeros(0, np.int32)])
        self.keys, self.at = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at = self.keys[order], self.at[order]

    def _pairs(self, ids: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the known words at a distance within one text, and the places of the first."""
        a, b = ids[:-distance].astype(np.int64), ids[distance:].astype(np.int64)
        at = np.flatnonzero((a > 0) & (b > 0) & (own[:-distance] == own[distance:]))
        return a[at] * (len(self.vocab) + 1) + b[at], own[at] if own is self.item else at

    def without_common(self, keys: np.ndarray, counts: np.ndarray) -> Items:
        """Without each item's commonest pairs, given how often the documents have the (sorted) ``keys``."""
        if len(self.keys):
            j = np.minimum(np.searchsorted(keys, self.keys), max(0, len(keys) - 1))
            often = np.where(keys[j] == self.keys, counts[j], 0) if len(keys) else np.zeros(len(self.keys), np.int64)
            order = np.lexsort((self.keys, -often, self.at))  # by item, the commonest first
            rank = np.arange(len(order)) - np.searchsorted(self.at[order], self.at[order])
            kept = np.sort(order[rank >= self.dropped[self.at[order]]])
            self.keys, self.at = self.keys[kept], self.at[kept]
        return self

    def read(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, 0 if no item has the word; number of the text of each; where each text starts) of texts in one array."""
        split = [plain_words(t) for t in batch]
        sizes = np.array([len(w) for w in split], np.int64)
        hashes = _hashes(list(chain.from_iterable(split)))
        j = np.minimum(np.searchsorted(self.vocab, hashes), max(0, len(self.vocab) - 1))
        ids = np.where(self.vocab[j] == hashes, j + 1, 0).astype(np.int32) if len(self.vocab) else np.zeros(len(hashes), np.int32)
        return ids, np.repeat(np.arange(len(batch), dtype=np.int32), sizes), np.append(0, np.cumsum(sizes))

    def seen(self, ids: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, keys) of the pairs of texts that some item has."""
        for distance in (1, 2):
            keys, at = self._pairs(ids, own, distance)
            j = np.searchsorted(self.keys, keys)
            found = self.keys[np.minimum(j, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
            yield at[found], keys[found]

    def candidates(self, ids: np.ndarray, own: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, past the last) of stretches with enough seeds, by text and item."""
        at, keys = map(np.concatenate, zip(*self.seen(ids, own)))
        order = np.argsort(at, kind="stable")
        at, keys = at[order], keys[order]
        first = np.searchsorted(self.keys, keys)
        n = np.searchsorted(self.keys, keys, side="right") - first
        # whole texts at a time, as many as have about _HITS hits
        of_text = np.bincount(own[at], n, len(starts) - 1).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        group = np.cumsum(of_text) // _HITS
        cuts = np.searchsorted(own[at], np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(of_text))) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            place = np.repeat(at[a:b], n[a:b])
            text = own[place].astype(np.int64)
            key = (text << (_PLACE + _ITEM)) | (self.at[_ranges(first[a:b], n[a:b])].astype(np.int64) << _PLACE) | (place - starts[text])
            key.sort()
            pair, p = key >> _PLACE, key & ((1 << _PLACE) - 1)
            k = pair & ((1 << _ITEM) - 1)
            j = np.arange(len(key)) + self.wanted[k] - 1
            j[j >= len(key)] = len(key) - 1
            ok = np.flatnonzero((pair[j] == pair) & (p[j] - p < self.span[k]) & (j - np.arange(len(key)) == self.wanted[k] - 1))
            if not len(ok):
                continue
            # stretches that meet are one
            pair, lo, hi = pair[ok], p[j[ok]] - self.span[k[ok]], p[ok] + self.span[k[ok]]
            new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (lo[1:] > hi[:-1])))
            for x, lo_, hi_ in zip(pair[new].tolist(), lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist()):
                d = x >> _ITEM
                yield d, x & ((1 << _ITEM) - 1), int(starts[d]) + max(0, lo_), min(int(starts[d + 1]), int(starts[d]) + hi_ + 1)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(best local score, where it ends in b, past the last): match 2, mismatch -1, gap -1; id 0 matches nothing."""
    along = np.arange(1, len(b) + 1)
    last, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        row = np.maximum(np.maximum(last[:-1] + np.where(b == x, 2 if x else -1, -1), last[1:] - 1), 0)
        row = np.maximum.accumulate(row + along) - along  # gaps along the row
        top = int(row.max(initial=0))
        if top > best:
            best, end = top, int(row.argmax()) + 1
        last[1:] = row
    return best, end


def matches(items: Items, batch: list[bytes]) -> Iterator[tuple[int, int, float, int]]:
    """(number of the text, item id, score, word where the alignment ends) of each pair whose alignment scores enough."""
    ids, own, starts = items.read(batch)
    held, best = None, (0, 0)
    for d, k, a, b in chain(items.candidates(ids, own, starts), [(-1, -1, 0, 0)]):
        if (d, k) != held:
            if held and best[0] >= items.least[held[1]]:
                size = int(items.starts[held[1] + 1] - items.starts[held[1]])
                yield held[0], items.item_ids[held[1]], best[0] / (2 * size), best[1]
            held, best = (d, k), (0, 0)
        if d < 0:
            break
        item = items.words[items.starts[k] : items.starts[k + 1]]
        if 2 * np.isin(item, ids[a:b]).sum() < items.least[k]:  # no word but these can match, each for 2
            continue
        score, end = smith_waterman(item, ids[a:b])
        if score > best[0]:
            best = (score, a + end - int(starts[d]))


def _slices(docs: DataFrame, benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The items, each slice without the pairs that ``docs`` have most often."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // SLICE_BYTES + 1
    for k in range(n):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()  # about SLICE_BYTES
        items = Items([(r[0], bytes(r[1])) for r in rows], least)
        if not len(items.keys):
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value.keys), np.int64)  # by the first place of each key
            for b in batches:
                ids, own, _ = sent.value.read(texts(b.column(0)))
                for _, keys in sent.value.seen(ids, own):
                    total += np.bincount(np.searchsorted(sent.value.keys, keys), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.keys[some]), pa.array(total[some])], ["key", "n"])

        counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most the pairs of a slice
        keys, often = (counts.column(c).to_numpy() for c in ("key", "n"))
        order = np.argsort(keys)
        yield items.without_common(keys[order], often[order])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of TEXTS rows at most, whatever the session's are: a text's number shares 64 bits with an item and a place."""
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield b.slice(at, TEXTS)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, end_word): each document and test item whose alignment scores ``least`` or more.

    Null and empty texts match nothing, and neither do items of under
    LEAST_WORDS words; items of up to LEAST_RAW / 2 words must be there whole.
    Very long texts are searched whole. Repeated rows give repeated results;
    repeated items count once; equal scores keep the first place. A null
    doc_id is kept. Extra columns may have any name. Empty tables: no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    arms = [own.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("end_word"))]
    for items in _slices(own, benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in _cut(batches):
                rows = list(matches(sent.value, texts(b.column(1))))
                if rows:
                    d, i, s, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(e, pa.int64())], ["doc_id", "item_id", "score", "end_word"])

        arms.append(own.mapInArrow(run, "doc_id long, item_id long, score double, end_word long"))
    return reduce(DataFrame.union, arms[1:] or arms)


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that no test item aligns with; their columns as they are. Each row is judged by its own text, without a join."""
    small_batches(docs.sparkSession)
    out = docs
    for items in _slices(docs, benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for b in _cut(batches):
                bad = {x[0] for x in matches(sent.value, texts(b.column(at)))}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_())) if bad else b

        out = out.mapInArrow(run, docs.schema)
    return out
