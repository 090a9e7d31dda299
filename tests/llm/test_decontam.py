"""Benchmark passages against full Smith-Waterman alignment of every item with every document."""

import random
from collections import Counter

import numpy as np
import pytest

from proofloom.llm import decontam
from test_llm import AWKWARD, docs_frame, sample_texts

ITEMS = "item_id long, text string"


def slow_align(item, text):
    a, b = decontam.plain_words(item.encode()), decontam.plain_words((text or "").encode())
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max(), len(a)


def wanted(items, rows, least=decontam.LEAST_SCORE):
    out = Counter()
    for i, t in items:
        for d, x in rows:
            if len(decontam.plain_words((t or "").encode())) >= decontam.LEAST_WORDS and (d or 0) < 8000:
                score, n = slow_align(t, x)
                if score >= max(2 * n * least, min(2 * n, decontam.LEAST_RAW)):
                    out[d, i, round(score / (2 * n), 6)] += 1
    return out


def found(spark, items, rows, **more):
    out = decontam.contaminated(docs_frame(spark, rows), spark.createDataFrame(items, ITEMS), **more).collect()
    return Counter((r.doc_id, r.item_id, round(r.score, 6)) for r in out if (r.doc_id or 0) < 8000)


def edited(rnd, words, every, how):
    """A copy with an edit at each ``every`` words: a word replaced, left out, put in, or two swapped."""
    out = list(words)
    for at in range(len(words) - 1 - rnd.randrange(every), 0, -every):
        kind = rnd.choice(how)
        if kind == "r":
            out[at] = f"new{rnd.randrange(99)}"
        elif kind == "d":
            del out[at]
        elif kind == "i":
            out.insert(at, f"new{rnd.randrange(99)}")
        elif at + 1 < len(out):
            out[at], out[at + 1] = out[at + 1], out[at]
    return out


def test_every_alignment_is_found_at_any_rate_of_edits(spark, data):
    """Edits at every 2nd to 10th word, of all sorts; words inserted between all; over common and rare words."""
    import duckdb

    items = duckdb.connect().sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet' ORDER BY item_id").fetchall()[:8]
    rnd, rows, n = random.Random(8), sample_texts(data, 12), 100
    items += [(500 + k, " ".join(rnd.choice(["of", "the", "a", "in", "and", f"u{rnd.randrange(50)}"]) for _ in range(rnd.choice([4, 5, 6, 7, 9, 12, 40])))) for k in range(14)]
    for i, t in items:
        w = t.split()
        for every in (2, 3, 4, 6, 10):
            for how in ("r", "d", "i", "rdis"):
                n += 1
                rows.append((n, f"of the a {rnd.random()} in " + " ".join(edited(rnd, w, every, how)) + f" and {rnd.random()} the"))
        rows.append((n := n + 1, " ".join(x for y in w for x in (y, f"gap{rnd.randrange(9)}"))))
    want = wanted(items, rows)
    assert found(spark, items, rows) == want
    rates = Counter(round(s, 1) for _, _, s in want)
    assert rates[0.5] > 20 and rates[0.6] > 20 and rates[0.8] > 20
    strict = wanted(items, rows, 0.8)
    assert found(spark, items, rows, least=0.8) == strict


def test_slices_and_common_pairs_change_nothing(spark, data, monkeypatch):
    import duckdb

    items = duckdb.connect().sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet' ORDER BY item_id").fetchall()
    rnd = random.Random(9)
    rows = sample_texts(data, 40)
    rows += [(1000 + k, rows[k][1] + " " + t.upper().replace(" ", "\n")) for k, (_, t) in enumerate(items[:9])]
    rows += [(2000 + k, " ".join(edited(rnd, t.split(), 4, "r"))) for k, (_, t) in enumerate(items[:9])]
    whole = found(spark, items, rows)
    assert whole == wanted(items, rows)
    monkeypatch.setattr(decontam, "SLICE_BYTES", 700)
    monkeypatch.setattr(decontam, "_HITS", 50)
    assert found(spark, items, rows + [(8000 + k, t) for k, t in rows]) == whole


def test_one_edited_copy_in_many_documents(spark):
    rnd = random.Random(18)
    item = [f"w{i}" for i in range(20)]
    copy = [f"x{i}" if i in (5, 10, 15) else w for i, w in enumerate(item)]
    rows = [(i, f"n{rnd.random()} " + " ".join(copy)) for i in range(130)]
    bench = spark.createDataFrame([(1, " ".join(item))], ITEMS)
    docs = docs_frame(spark, rows)
    assert {r.doc_id: (r.score, r.end_word) for r in decontam.contaminated(docs, bench).collect()} == {i: (pytest.approx(0.775), 22) for i in range(130)}
    assert decontam.clean_documents(docs, bench).count() == 0


def test_awkward_documents_and_items(spark, data):
    items = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "of the"), (5, "of the in a"), (None, "some item without any number of its own")]
    long = "word " * 50_000 + "alpha beta gamma delta epsilon " + "of the " * 50_000
    rows = [*AWKWARD, (10, long), (10, long), (None, "Alpha, beta: gamma; DELTA epsilon!"), (11, "of the in b"), (12, "of the in a"), (13, "some item without any number of its own")]
    docs, bench = docs_frame(spark, rows), spark.createDataFrame(items, ITEMS)
    out = Counter((r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, bench).collect())
    assert out == Counter({(10, 1, 1.0): 2, (None, 1, 1.0): 1, (12, 5, 1.0): 1, (13, None, 1.0): 1})
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in AWKWARD) + Counter([11])
    for a, b in ((docs, bench.limit(0)), (docs.limit(0), bench)):
        assert decontam.contaminated(a, b).collect() == [] and decontam.clean_documents(a, b).count() == a.count()
    assert decontam.contaminated(docs, bench.limit(0)).columns == ["doc_id", "item_id", "score", "end_word"]


def test_batches_of_any_number_of_rows(spark):
    item = "twelve quite unusual words that stand together in this one benchmark item"
    rows = [(k, f"short text number {k}") for k in range(20_000)]
    rows[5], rows[19_990] = (5, item), (19_990, f"before {item} after")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item)], ITEMS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == {5, 19_990}
        assert {r.doc_id for r in decontam.clean_documents(docs, bench).collect()} == {k for k, _ in rows} - {5, 19_990}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
