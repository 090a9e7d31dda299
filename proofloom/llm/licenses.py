"""Licence scans with ordered signature rules.

The words of a whole text (runs of ASCII letters and digits and of characters
beyond ASCII, A-Z lowered) are joined by single spaces. One automaton over the
rules' keywords passes over them; only rules whose keywords are all there run
their pattern. Detections are intervals of words: one that lies within a
detection of higher priority, or of the same priority and longer, or equal and
of an earlier rule, gives way. Base phrases are counted at every place and are
never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, trim, worker_cache
from .decontam import plain_words
from .license_rules import rules

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Scanner:
    def __init__(self) -> None:
        self.rules = [(label, priority, keywords, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")) for label, priority, keywords, pattern in rules()]
        self.by_word: dict[str, list[int]] = {}
        for k, (_, _, keywords, _) in enumerate(self.rules):
            for w in keywords:
                self.by_word.setdefault(w, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for w in self.by_word:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def detections(self, line: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in characters of what no other detection suppresses, by place."""
        seen = {w for _, w in self.automaton.iter(line)}
        if not seen:
            return []
        own = sorted({k for w in seen for k in self.by_word[w] if seen.issuperset(self.rules[k][2])})
        found = [(m.start(), m.end(), k) for k in own for m in self.rules[k][3].finditer(line) if m.end() > m.start()]
        # by start, the longest first: a detection can only lie within one before it, or one of the same interval
        found.sort(key=lambda x: (-self.rules[x[2]][1], x[0] - x[1], x[2], x[0]))
        kept: list[tuple[int, int, int]] = []  # by place
        reach = max((b - a for a, b, _ in found), default=0)
        for a, b, k in found:
            at = bisect_right(kept, (a, len(line) + 1, 0))
            near = at
            while near and kept[near - 1][0] >= a - reach and kept[near - 1][1] < b:
                near -= 1
            if not near or kept[near - 1][0] < a - reach:
                kept.insert(bisect_right(kept, (a, b, k)), (a, b, k))
        return kept


def _words_before(line: bytes | str, places: list[int]) -> dict[int, int]:
    """How many spaces stand before each place; one pass."""
    out, at, n = {}, 0, 0
    gap = " " if isinstance(line, str) else b" "
    for p in sorted(set(places)):
        n += line.count(gap, at, p)
        out[p] = n
        at = p
    return out


def _scanner() -> Scanner:
    cache = worker_cache("licenses")
    if "scanner" not in cache:
        cache["scanner"] = Scanner()
    return cache["scanner"]


def scan(text: bytes) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one text.

    detections: (label, first word, words) of each surviving rule. score is the
    highest priority found over 9; a base phrase counts as a name (5).
    """
    w = plain_words(text)
    line = b" " + b" ".join(w) + b" "
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = line.find(needle, at + 1)
    starts = list(_words_before(line, starts).values())  # phrases start at different words
    own = _scanner()
    inner = line[1:-1].decode()
    kept = own.detections(inner)
    word = _words_before(inner, [x for a, b, _ in kept for x in (a, b)])
    found = [(own.rules[k][0], word[a], word[b] - word[a] + 1, own.rules[k][1]) for a, b, k in kept]
    best = max([x[3] for x in found] + [5] * bool(base), default=0)
    return {
        "n_words": len(w),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {x[0] for x in found})),
        "score": best / 9,
        "detections": [{"label": a, "first": b, "n": c} for a, b, c, _ in found],
    }


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the fields of :func:`scan`.

    Null and empty texts have no words, no labels and score 0. Repeated rows
    stay, each judged by itself. Empty input: no rows.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:]]], schema=schema)
        trim()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, first: bigint, n: bigint>>"
    )
