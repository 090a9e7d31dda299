"""Files of a store, parsers by name, progress of streams, events in order."""

import time

from pyspark.sql import functions as F

from proofloom.operators import brief, pages
from proofloom.sources import stores
from proofloom.streaming import ingest


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("a/one.pdf", b"%PDF 1"), ("two.pdf", b"%PDF 2"), ("notes.txt", b"text")):
        (tmp_path / name).write_bytes(data)
    got = {(r.name, bytes(r.content)) for r in stores.files(spark, f"file://{tmp_path}", "*.pdf").collect()}
    assert got == {("one.pdf", b"%PDF 1"), ("two.pdf", b"%PDF 2")}
    assert stores.files(spark, f"file://{tmp_path}").count() == 3


def test_pages_go_to_the_reader_that_their_parser_names(spark):
    routed = pages.parsers(spark.createDataFrame([(1, 1, 500), (1, 2, 3), (2, 1, 51), (2, 2, 50)], "doc_id long, page int, chars int"))
    told = lambda name: lambda own: own.select("doc_id", "page", F.lit(name).alias("content"))
    out = pages.dispatched(routed, {"textlayer": told("read"), "ocr": told("seen")})
    assert sorted(map(tuple, out.collect())) == [(1, 1, "read"), (1, 2, "seen"), (2, 1, "read"), (2, 2, "seen")]
    assert sorted(map(tuple, pages.dispatched(routed, {"textlayer": told("read")}).collect())) == [(1, 1, "read"), (2, 1, "read")]


def test_progress_of_streams(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k}") for k in range(12)], "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    seen = []
    listener = ingest.Progress(lambda name, batch, rows: seen.append((name, batch, rows)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/docs")
        stream.writeStream.queryName("watched").format("noop").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 30
        while sum(r for n, _, r in seen if n == "watched") < 12 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    own = [x for x in seen if x[0] == "watched" and x[2]]
    assert [b for _, b, _ in own] == sorted(b for _, b, _ in own) and len(own) == 3 and sum(r for *_, r in own) == 12


def test_events_in_order(spark):
    claim = "array<struct<text:string,citations:array<struct<page:int,block_id:int>>>>"
    rows = [(2, "qa", 1, "relevant", None, True, None), (1, "calc", 3, "weak", [("t", [(1, 2)])], False, ["9", "8"])]
    answered = spark.createDataFrame(rows, f"qid long, task string, attempts int, grade string, claims {claim}, verified boolean, unverified array<string>")
    got = [(r.qid, r.seq, r.step, r.detail) for r in ingest.in_order(brief.events(answered).repartition(4))]
    steps = ["supervise", "retrieve", "grade", "generate", "cite_check"]
    assert [(q, s, t) for q, s, t, _ in got] == [(q, k, step) for q in (1, 2) for k, step in enumerate(steps)]
    assert got[4][3] == "9, 8" and got[9][3] == "verified" and got[1][3] == "attempts=3" and got[8][3] == "claims=0"
    numbered = stores.numbered if hasattr(stores, "numbered") else ingest.numbered
    again = numbered(spark.createDataFrame([("a", 5), ("b", 1), ("a", 2)], "k string, at int"), "k", "at")
    assert sorted(map(tuple, again.collect())) == [("a", 2, 0), ("a", 5, 1), ("b", 1, 0)]
