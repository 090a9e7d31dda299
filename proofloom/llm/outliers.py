"""Quality rules: base counts of every document, and robust multivariate outliers.

Each document has a vector of transformed statistics, rounded to a grid. For
each language and source the minimum-covariance-determinant estimate is fitted
to the grid cells weighted by their documents, and cells beyond a chi-squared
quantile of the squared Mahalanobis distance are rejected. A cell count needs no
more room than the grid, so a hot source is summed before any shuffle and no
task ever holds its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches, texts, trim

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CELL = ["q1", "q2", "q3", "q4", "q5"]
#: Least spread of each statistic, in its own unit: constant statistics don't make the covariance singular.
FLOOR = np.array([1.0, 0.25, 1.0, 2.0, 2.0])
STEP = 8  # grid cells a unit
WINDOW = 5
CHUNK = 4 << 20
_NOT_IN_WORDS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))  # white space, and UTF-8 bytes that start no code point


def _repeats(docs: list[list[bytes]]) -> np.ndarray:
    """Words of each document that stand in a window of WINDOW words found twice or more in it; exact."""
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for d in docs for w in d], np.int64)
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs), np.int64)
    if len(a) < WINDOW:
        return out
    doc = np.repeat(np.arange(len(docs)), sizes)
    inside = np.flatnonzero(doc[: len(a) - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(inside):
        return out
    # windows are numbered by numbering pairs, then pairs of pairs, then those with the last word
    two, _ = pd.factorize(a[:-1] * len(ids) + a[1:])
    four, u = pd.factorize(two[:-2] * (two.max() + 1) + two[2:])
    five, u = pd.factorize(four[:-1] * len(ids) + a[4:])
    own, u = pd.factorize(five[inside] * len(docs) + doc[inside])
    again = inside[np.bincount(own, minlength=len(u))[own] > 1]
    step = np.zeros(len(a) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(docs)).astype(np.int64)


def base_counts(batch: list[bytes]) -> np.ndarray:
    """One row of COUNTS for each text."""
    out = np.zeros((len(batch), len(COUNTS)), np.int64)
    held, first, size = [], 0, 0
    for k, t in enumerate(batch):
        w = t.split()
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[k, :4] = len(w), len(t.translate(None, _NOT_IN_WORDS)), len(t) - len(t.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines))
        held.append(w)
        size += len(t)
        if size >= CHUNK or k + 1 == len(batch):
            out[first : k + 1, 4] = _repeats(held)
            held, first, size = [], k + 1, 0
    return out


def counted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default all) in a struct ``row``, and COUNTS of each row's text. Null text: zeros."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = base_counts(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(n[:, i]) for i in range(n.shape[1])]], ["row", *COUNTS])
        trim()

    small_batches(docs.sparkSession)
    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cells() -> list[Column]:
    """The statistics on their grid: words, word length, symbols, repeated lines and repeated windows for each word, all as logarithms."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda c: F.log2(1 + 1000 * F.col(c) / n)
    stats = [F.log2(1 + F.col("n_words")), F.log2(1 + F.col("word_chars") / n), per("n_symbols"), per("n_dup_lines"), per("n_repeat_words")]
    return [F.round(s * STEP).cast("int").alias(q) for s, q in zip(stats, CELL)]


def _chi2_cdf(x: float, p: int) -> float:
    """For odd p."""
    term, total = 1.0, 0.0
    for k in range((p - 1) // 2):
        total += term
        term *= x / (2 * k + 3)
    return erf(sqrt(x / 2)) - sqrt(2 * x / pi) * exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def _moments(x: np.ndarray, w: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = w @ x / w.sum()
    d = x - m
    return m, (d * w[:, None]).T @ d / w.sum() + np.diag(floor**2)


def _distances(x: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    d = x - m
    return np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T)


def _weighted_median(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = []
    for c in x.T:
        o = np.argsort(c, kind="stable")
        out.append(c[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)])
    return np.array(out)


def mcd(x: np.ndarray, w: np.ndarray, share: float = 0.75, floor: np.ndarray = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the ``share`` of the weight whose covariance has the least determinant.

    Deterministic starts (median with scaled median deviations, spatial signs,
    plain moments), each followed by concentration steps to a
    fixed point; the best one counts. A cell on the border takes part with the
    weight that is missing. ``floor`` squared is added to each variance.
    """
    p = x.shape[1]
    h = share * w.sum()

    def subset(m: np.ndarray, s: np.ndarray) -> np.ndarray:
        o = np.argsort(_distances(x, m, s), kind="stable")
        before = np.cumsum(w[o]) - w[o]
        out = np.zeros(len(w))
        out[o] = np.clip(h - before, 0, w[o])
        return out

    mid = _weighted_median(x, w)
    mad = np.diag((1.4826 * _weighted_median(np.abs(x - mid), w)) ** 2 + floor**2)
    unit = (x - mid) / np.maximum(np.linalg.norm((x - mid) / floor, axis=1, keepdims=True), 1e-9)
    starts = [(mid, mad), (mid, _moments(unit, w, floor)[1]), _moments(x, w, floor)]
    best = None
    for m, s in starts:
        held = None
        for _ in range(100):
            part = subset(m, s)
            if held is not None and np.allclose(part, held, rtol=0, atol=1e-9 * h):
                break
            held = part
            m, s = _moments(x, part, floor)
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0] - 1e-12:
            best = det, m, s
    _, m, s = best
    q = chi2_quantile(share, p)
    return m, (s - np.diag(floor**2)) * (share / _chi2_cdf(q, p + 2)) + np.diag(floor**2)


def _judge(share: float, tail: float, least: int):
    cut = chi2_quantile(1 - tail, len(CELL))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["n"].sum() < least:
            return pdf.loc[[], ["pool", *CELL]]
        pdf = pdf.sort_values(CELL)
        x = pdf[CELL].to_numpy(np.float64) / STEP
        m, s = mcd(x, pdf["n"].to_numpy(np.float64), share)
        return pdf.loc[_distances(x, m, s) > cut, ["pool", *CELL]]

    return run


def rejected_cells(counts: DataFrame, lang: Column, source: Column, share: float = 0.75, tail: float = 1e-6, least: int = 100) -> DataFrame:
    """(lang, source, CELL) of the grid cells that are outliers of their group.

    A language and source with fewer than ``least`` documents is judged by its
    whole language, and a language with fewer by the whole table; below that,
    nothing is rejected. Documents that fail the base rules take no part.
    """
    own = counts.filter(~base_failed()).select(lang.alias("lang"), source.alias("source"), *cells())
    found = saved(own.groupBy("lang", "source", *CELL).agg(F.count("*").alias("n")), "cells")
    key = lambda k: F.to_json(F.struct(F.lit(k).alias("level"), *([F.col("lang")] if k < 2 else []), *([F.col("source")] if k < 1 else [])))
    sized = found.groupBy("lang", "source").agg(F.sum("n").alias("of_source")).withColumn("of_lang", F.sum("of_source").over(Window.partitionBy("lang")))
    pool = F.when(F.col("of_source") >= least, key(0)).when(F.col("of_lang") >= least, key(1)).otherwise(key(2))
    groups = saved(sized.select("lang", "source", pool.alias("pool")), "groups")
    fits = found.select(F.explode(F.array(key(0), key(1), key(2))).alias("pool"), *CELL, "n").join(groups.select("pool"), "pool", "left_semi")
    bad = fits.groupBy("pool", *CELL).agg(F.sum("n").alias("n")).groupBy("pool").applyInPandas(_judge(share, tail, least), "pool string, " + ", ".join(f"{q} int" for q in CELL))
    return saved(bad.join(groups, "pool").select("lang", "source", *CELL), "rejected")


def verdicts(counts: DataFrame, lang: Column, source: Column, **how) -> DataFrame:
    """``counts`` with base_failed and kept. ``lang`` and ``source`` are columns of ``counts``, null being a group."""
    bad = rejected_cells(counts, lang, source, **how).withColumn("bad", F.lit(True))
    put = counts.withColumns({"_lang": lang, "_source": source}).withColumns({f"_{q}": c for q, c in zip(CELL, cells())})
    same = put["_lang"].eqNullSafe(bad["lang"]) & put["_source"].eqNullSafe(bad["source"])
    for q in CELL:
        same &= put[f"_{q}"] == bad[q]
    return put.join(bad, same, "left").select(*[put[c] for c in counts.columns], base_failed().alias("base_failed"), (~base_failed() & F.col("bad").isNull()).alias("kept"))


def judged(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id, COUNTS, base_failed, kept.

    Null text: no words, so base_failed. Null lang or source: a group of its
    own. Repeated rows count each. Empty input: no rows.
    """
    counts = saved(counted(docs, keep=["doc_id", "lang", "source"]), "counts")
    out = verdicts(counts, F.col("row.lang"), F.col("row.source"), **how)
    return out.select("row.doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are. Texts are counted again rather than joined back."""
    counts = counted(docs, keep=["lang", "source"])
    small = saved(counts, "counts")
    bad = rejected_cells(small, F.col("row.lang"), F.col("row.source"), **how).withColumn("bad", F.lit(True))
    whole = counted(docs).filter(~base_failed()).withColumns({f"_{q}": c for q, c in zip(CELL, cells())})
    same = whole["row.lang"].eqNullSafe(bad["lang"]) & whole["row.source"].eqNullSafe(bad["source"])
    for q in CELL:
        same &= whole[f"_{q}"] == bad[q]
    return whole.join(bad, same, "left_anti").select("row.*")
