"""A whole report through page extraction, chunks, retrieval and answers, and the quality that must hold on it."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from proofloom.operators import answer, brief, evals, layout, pages, retrieve
from proofloom.operators.providers import ProviderDown, Router
from proofloom.sources import stores
from report import QUESTIONS, page_tables, report_chunks


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers have no tests


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('report')}/chunks"
    report_chunks(spark).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def retriever(spark, chunks):
    return retrieve.LocalRetriever(chunks)


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def test_extracted_blocks(spark):
    got = pages.extract(*page_tables(spark)).collect()
    by = lambda p: [(r.type, r.content) for r in sorted((r for r in got if r.page == p), key=lambda r: r.block_id)]
    assert by(1)[0] == ("figure", "") or ("figure", "") in by(1)
    assert sum(k == "figure" for p in range(1, 7) for k, _ in by(p)) == 1, "a small image, and one that a table holds, are no figures"
    assert by(4)[0][0] == "table" and [c for k, c in by(4) if k == "title"] == ["Consolidated Income Statement", "Income Statement (GBP m)"]
    assert not any(c == "5,952" for p in range(1, 7) for _, c in by(p)), "texts of the table belong to it"
    order = [r.content for r in sorted((r for r in got if r.page == 4 and r.ord is not None), key=lambda r: r.ord)]
    assert order[0] == "Consolidated Income Statement" and order[-1].startswith("| Segment")
    marked = layout.mark_furniture(pages.extract(*page_tables(spark)).withColumn("seq", F.col("block_id")))
    assert marked.filter("type = 'footer'").count() == 6
    no_rules = page_tables(spark)[:4]
    assert pages.extract(*no_rules, page_tables(spark)[4].limit(0)).filter("type = 'table'").count() == 0


def test_retrieval_quality(spark, retriever):
    q = ask(spark, *[x[0] for x in QUESTIONS])
    ranked = retriever.retrieve(q, 5).select("qid", F.col("pos").alias("rank"), "page").filter("rank < 5")
    gold = spark.createDataFrame([(i, x[1]) for i, x in enumerate(QUESTIONS) if x[1]], "qid long, pages array<int>")
    m = evals.hit_and_mrr(evals.first_hits(ranked, gold)).first()
    assert m.n == 21 and m.hit_rate >= 0.9 and m.mrr >= 0.7


def test_answer_quality(spark, retriever):
    out = {r.qid: r for r in answer.answer(ask(spark, *[x[0] for x in QUESTIONS]), retriever=retriever).collect()}
    inside, outside = [i for i, x in enumerate(QUESTIONS) if x[1]], [i for i, x in enumerate(QUESTIONS) if not x[1]]
    abstained = [out[i].answer.startswith(answer.ABSTAIN) for i in outside]
    answered = [i for i in inside if not out[i].answer.startswith(answer.ABSTAIN)]
    cited = [any(c.page in QUESTIONS[i][1] for cl in out[i].claims for c in cl.citations) for i in answered]
    assert sum(abstained) / len(outside) >= 0.75 and len(answered) / len(inside) >= 0.9 and sum(cited) / len(answered) >= 0.8
    assert all(out[i].verified and out[i].claims and out[i].sources and len(out[i].sources) <= 3 for i in answered)
    assert all(out[i].sources is None and out[i].claims is None for i in outside if out[i].answer == answer.ABSTAIN)
    lanes = [out[i].task == (x[2] or "qa") for i, x in enumerate(QUESTIONS)]
    assert sum(lanes) / len(lanes) >= 0.88


class Stub:
    def __init__(self, replies, down=()):
        self.replies, self.down = replies, down

    def has_key(self, model):
        return model != "keyless"

    def complete(self, model, prompt):
        if model in self.down:
            raise ProviderDown(model)
        return next((r for k, r in self.replies.items() if k in prompt), "")


def test_model_answers_are_checked(spark, retriever):
    good = '```json\n{"answer": "Operating profit was 1,052.", "claims": [{"text": "Operating profit was 1,052", "citations": [{"page": 4, "block_id": 99}, {"page": 4, "block_id": null}]}]}\n```'
    bad = '{"answer": "Revenue was 9,999.", "claims": [{"text": "Revenue was 9,999", "citations": [{"page": 3}]}]}'
    stub = Stub({"operating profit": good, "total revenue": bad, "tax rate": '{"answer": "no", "claims": [], "insufficient": true}', "earnings per share": "About 712 pence, I think; maybe 888."})
    out = {r.qid: r for r in answer.answer(ask(spark, "What was operating profit in FY26?", "What was total revenue in FY26?", "What was the effective tax rate for the year?", "What were earnings per share?"), retriever=retriever, router=Router({"answer": "a"}, stub)).collect()}
    assert out[0].verified and out[0].answer == "Operating profit was 1,052." and [c.page for c in out[0].claims[0].citations] == [4]
    assert not out[1].verified and out[1].unverified == ["9,999".replace(",", "")] or out[1].unverified == ["9,999"]
    assert "unverified figure" in out[1].answer and out[2].answer == answer.ABSTAIN
    assert out[3].answer.startswith("About 712 pence") and out[3].unverified == ["888"]
    assert answer.answer(ask(spark, "What was operating profit in FY26?"), retriever=retriever, router=Router({"answer": "a"}, Stub({}))).first().answer.startswith("Based on the document")


def test_computed_answers(spark, retriever):
    router = Router({"fast": "f"}, Stub({"net assets": "1,430 - 1,280"}))
    out = answer.answer(ask(spark, "By how much did net assets change year on year?"), retriever=retriever, router=router).first()
    assert out.task == "calc" and out.computed == 150.0


def test_document_scope(spark, chunks):
    both = chunks.unionByName(chunks.withColumn("doc_id", F.lit(2).cast("long")).withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id")))
    r = retrieve.LocalRetriever(both)
    q = ask(spark, "What was operating profit in FY26?", "Compare 1,052 versus 985 in FY26")
    assert {x.doc_id for x in r.retrieve(q, 6, [2]).collect()} == {2} and {x.doc_id for x in r.retrieve(q, 6).collect()} == {1, 2}
    assert isinstance(r, retrieve.Retriever) and retrieve.make_retriever(both, remote=r) is r
    found = retrieve.search_document(r, "What was operating profit in FY26?", doc_id=1, k=3)
    assert len(found) >= 3 and {x["doc_id"] for x in found} == {1}
    assert "error" in retrieve.search_document(None, "x")[0]


class Vectors:
    dim = 4

    def embed_docs(self, texts):
        return [[1.0, 0, 0, 0] if "dividend" in t.lower() else [0, 1.0, 0, 0] for t in texts]

    def embed_query(self, text):
        return [1.0, 0, 0, 0]


class Broken(Vectors):
    def embed_docs(self, texts):
        raise RuntimeError("no service")

    embed_query = embed_docs


def test_vectors_contribute_and_degrade(spark, chunks):
    dense = stores.with_vectors(chunks, Vectors())
    found = retrieve.LocalRetriever(dense, embedder=Vectors()).retrieve(ask(spark, "shareholder payout policy"), 5).collect()
    assert any("dividend" in r.content.lower() for r in found)
    assert not stores.has_vectors(stores.with_vectors(chunks, Broken())) and stores.has_vectors(dense)
    plain = retrieve.LocalRetriever(dense, embedder=Broken()).retrieve(ask(spark, "total dividend"), 3)
    assert plain.count() >= 1


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 8)).round(1)
    v[5] = v[9] = v[100]
    v[7] = 0
    frame = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (900, None), (901, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([*((i, v[i].tolist()) for i in range(0, 300, 20)), (777, None)], "qid long, query array<float>")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 6)
    got = {(r.qid, r.rank): (r.vec_id, r.score) for r in retrieve.dense_top(queries, frame, 12).collect()}
    unit = v.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = {}
    for i in range(0, 300, 20):
        s = np.round(unit @ unit[i], 6)
        order = sorted((k for k in range(300) if k != 7), key=lambda k: (-s[k], k))[:12]
        want |= {(i, n): (k, pytest.approx(s[k])) for n, k in enumerate(order)}
    assert got == want
    assert retrieve.dense_top(queries.limit(0), frame).count() == 0 == retrieve.dense_top(queries, frame.limit(0)).count()


def test_model_rerank_falls_back(spark):
    q = spark.createDataFrame([(1, "total revenue")], "qid int, question string")
    c = spark.createDataFrame([(1, "a", "text", "", "x", 1.0), (1, "b", "text", "", "y", 0.5)], "qid int, chunk_id string, type string, heading string, content string, score double")
    good = {r.chunk_id: r.score for r in retrieve.model_rerank(q, c, lambda qs, cs: [{"x": 0.1, "y": 0.9}[t] for t in cs]).collect()}
    assert good == {"a": 0.1, "b": 0.9}

    def broken(qs, cs):
        raise RuntimeError

    assert {r.chunk_id: r.score for r in retrieve.model_rerank(q, c, broken).collect()} == {r.chunk_id: r.score for r in retrieve.rerank(q, c).collect()}


def test_brief(spark, retriever):
    rows = brief.run_brief(retriever)
    found = rows.orderBy("qid").collect()
    assert [r.heading for r in found] == [h for h, _ in answer.BRIEF] and found[0].status == "answered"
    text = brief.brief_markdown(rows, "Acme")
    assert text.startswith("# Analyst brief — Acme\n") and "**Revenue.**" in text and f"of {len(answer.BRIEF)} items answered" in text
    assert brief.cite_marks([{"citations": [{"page": 3, "block_id": 1}, {"page": 3, "block_id": None}]}, {"citations": [{"page": 3, "block_id": 1}]}]) == "[p3·b1] [p3]"
    seen = brief.events(answer.answer(ask(spark, "What was operating profit in FY26?"), retriever=retriever)).orderBy("seq").collect()
    assert [r.step for r in seen] == ["supervise", "retrieve", "grade", "generate", "cite_check"] and seen[0].detail == "qa"


def test_comparison(spark):
    items = brief.checklist(spark, [("Revenue", "r"), ("EPS", "e"), ("Cash", "c"), ("Margin", "m")])
    figure = "qid long, value double, raw string, unit string, page int, block_id int"
    a = spark.createDataFrame([(0, 40.8, "40.8", "million", 3, 6), (1, 0.01, "0.01", "per_share", 4, None), (2, 1.0, "1", "bare", 1, 1)], figure)
    b = spark.createDataFrame([(0, 33.4, "33.4", "million", 2, 1), (1, 2.8, "2.8", "million", 4, 1)], figure)
    text = brief.compare_markdown(brief.compare_rows(a, b, items), "2026", "2025")
    assert "| Revenue | 40.8 [p3·b6] | 33.4 [p2·b1] | +7.4 (+22.2%) |" in text and "| EPS | 0.01 [p4] | 2.8 [p4·b1] | _not compared" in text
    assert "| Cash | 1 [p1·b1] | — | — |" in text and "| Margin | — | — | _not disclosed_ |" in text and "_1 of 4 metrics compared" in text
    ev = spark.createDataFrame([(0, 0, 3, 6, "Total revenues were $40.8 million in 2023", "")], "qid long, pos int, page int, block_id int, content string, parent_text string")
    out = spark.createDataFrame([(0, [("In 2023 revenue was $40.8 million.", [(3, 6)])])], "qid long, claims array<struct<text:string,citations:array<struct<page:int,block_id:int>>>>")
    assert brief.figures_of(out, ev).first()[1:4] == (40.8, "40.8", "million")


def test_compared_reports(spark, retriever, chunks):
    chunks = chunks.withColumn("pos", F.lit(0))
    rows = brief.run_compare(retriever, retriever).orderBy("qid").collect()
    assert [r.heading for r in rows] == [h for h, _ in brief.COMPARED] and all(r.status in ("compared", "not_disclosed") for r in rows)


def test_replies(spark):
    texts = {
        1: 'Sure!\n```json\n{"answer": " A ", "claims": [{"text": " t ", "citations": [{"page": 3, "block_id": 7}, {"page": "3"}, {"page": 4, "block_id": "x"}, 5]}, {"text": ""}, {"nope": 1}, 7]}\n```',
        2: "no json", 3: '{"answer": 5}', 4: '{"answer": "x", "insufficient": true}', 5: None, 6: '{"answer": "x", "claims": "none", "insufficient": 0}', 7: "{broken", 8: '{"answer": "nested {braces}"} trailing', 9: '["answer"]',
    }
    out = {r.i: r.p for r in spark.createDataFrame(list(texts.items()), "i int, t string").select("i", answer.parse_reply("t").alias("p")).collect()}
    assert out[1].answer == "A" and [(c.text, [tuple(x) for x in c.citations]) for c in out[1].claims] == [("t", [(3, 7), (4, None)])] and not out[1].insufficient
    assert [out[i] for i in (2, 3, 5, 7, 9)] == [None] * 5 and out[4].insufficient and out[4].claims == []
    assert out[6].claims == [] and not out[6].insufficient and out[8].answer == "nested {braces}"


def test_router():
    stub = Stub({"q": "yes"}, down={"b"})
    now = [0.0]
    r = Router({"fast": "keyless, b ,, c", "judge": "keyless"}, stub)
    r.cooldown.now = lambda: now[0]
    assert r.chains["fast"] == ["keyless", "b", "c"] and r.label("fast") == "b" and r.label("judge") == "offline" and not r.available("answer")
    assert r.complete("fast", "q") == "yes" and not r.cooldown.ready("b")
    now[0] = 61.0
    assert r.cooldown.ready("b")
    with pytest.raises(RuntimeError, match="empty"):
        r.complete("fast", "unknown")
    assert r.cooldown.ready("c"), "an empty answer is no reason to rest"
    with pytest.raises(ValueError):
        Router({"poet": "a"})
