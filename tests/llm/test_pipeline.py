"""The corpus pipeline as chained, on small tables, against its operators' brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from proofloom.llm.common import tokenizer_file
from test_decontam import slow_align
from test_llm import split
from test_near_copies import jaccard

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def folder(spark, tmp_path, rows, items, schema=DOCUMENTS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(21)
    items = [(k, sentences(rnd, 25)) for k in range(4)]
    clean = {k: sentences(rnd, rnd.randint(150, 300)) for k in range(60)}
    rows = [(k, t, "en", "web" if k % 4 else "books", len(t)) for k, t in clean.items()]
    rows += [(100 + k, clean[k], "en", "web", 0) for k in range(10)]  # exact copies
    for k in range(10):
        w = split(clean[k + 10])
        w[60] = "edited"
        rows.append((200 + k, " ".join(w), "en", "web", 0))
        assert jaccard(clean[k + 10], rows[-1][1]) >= 0.8
    leaks = {300 + k: sentences(rnd, 80) + " " + items[k][1] + " " + sentences(rnd, 80) for k in range(4)}
    rows += [(k, t, "en", "web", 0) for k, t in leaks.items()]
    rows += [(400, None, None, None, None), (401, "", "en", "web", 0), (402, "too short", "en", "web", 0), (403, "again and again it goes " * 30, "en", "web", 0)]
    rows += [(1, clean[1], "en", "web", 0), (None, clean[30] + " unnumbered", "en", "web", 0), (5, sentences(rnd, 200), "de", None, 0)]  # a repeated row, no id, an id with a second text
    sf = folder(spark, tmp_path, rows, items)
    out = corpus_pipeline.run(spark, sf).collect()
    assert set(out[0].__fields__) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
    got = Counter(r.doc_id for r in out)
    assert set(got) == set(clean) | {None}, "all that is clean, and nothing that is a copy, a leak or junk"
    assert all(slow_align(t, clean[k])[0] < 25 for k in range(0, 60, 20) for _, t in items)
    tk = Tokenizer.from_file(tokenizer_file())
    sizes = {d: {len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in rows if i == d} for d in got}
    assert all(r.n_tokens in sizes[r.doc_id] for r in out)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_keep_the_columns_of_documents(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_files"]


@pytest.mark.parametrize("items", [[(1, "some item that no document has at all")], []])
def test_empty_tables_and_extra_columns(spark, tmp_path, items):
    rnd = random.Random(3)
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [], items)).collect() == []
    rows = [(k, sentences(rnd, 60), "en", "web", 0, "x", 1, 2) for k in range(12)]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path / "more", rows, items, DOCUMENTS + ", row string, node int, block int")).collect()
    assert {r.doc_id for r in out} == set(range(12))
