"""Stores, registries, page routing and streams on small cases."""

import pytest
from pyspark.sql import functions as F

from proofloom.operators import layout
from proofloom.sources import stores
from proofloom.streaming import ingest


def test_keyed_store(spark, tmp_path):
    s = stores.page_cache(spark, f"file://{tmp_path}/pages")
    row = lambda *rows: spark.createDataFrame(rows, "doc_hash string, page int, parser string, blocks string")
    assert s.get().count() == 0
    s.put(row(("h", 1, "ocr", "a"), ("h", 2, "ocr", "b"), ("h", 2, "ocr", "b")))
    s.put(row(("h", 2, "ocr", "c"), ("h_x", 3, "textlayer", "d")))
    assert sorted(map(tuple, s.get().collect())) == [("h", 1, "ocr", "a"), ("h", 2, "ocr", "c"), ("h_x", 3, "textlayer", "d")]
    hit, miss = s.split(spark.createDataFrame([("h", 2, "ocr"), ("h", 9, "ocr")], "doc_hash string, page int, parser string"))
    assert hit.first().blocks == "c" and [r.page for r in miss.collect()] == [9]
    assert {r.doc_hash for r in s.scan("h_").collect()} == {"h_x"} and {r.doc_hash for r in s.scan("h_", literal=False).collect()} == {"h_x"}
    assert {r.doc_hash for r in s.scan("_", literal=False).collect()} == {"h", "h_x"} and s.scan("_").count() == 0
    assert [tuple(r) for r in stores.cached_pages(s.get().filter("doc_hash = 'h'")).collect()] == [("h", "ocr", [1, 2])]
    b = stores.blob_store(spark, f"file://{tmp_path}/blobs")
    b.put(spark.createDataFrame([("doc/1", bytearray(b"\x00pdf"))], "key string, content binary"))
    assert bytes(b.scan("doc/").first().content) == b"\x00pdf"


def files_read(df):
    return {f.rsplit("/data/", 1)[1] for f in df.inputFiles()}


def test_keyed_store_levels(spark, tmp_path):
    s = stores.text_cache(spark, f"file://{tmp_path}/texts")
    s.FANOUT = 3
    row = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    want = {}
    for n in range(10):
        put = {f"{'abc'[n % 3]}{k}": f"{n}" for k in range(n, n + 4)}
        s.put(row(*put.items()))
        want |= put
        if n == 4:
            s.remove(row(("b1", None), ("zz", None)).select("key"))
            del want["b1"]
        assert dict(map(tuple, s.get().collect())) == want, n
    levels = [e["level"] for e in s.entries()]
    assert max(levels) >= 2 and all(levels.count(k) < 3 for k in set(levels)) and len(levels) < 6
    # of 11 puts a scan opens files with the prefix only
    every, some = files_read(s.get()), files_read(s.scan("c1"))
    assert {r.key for r in s.scan("c1").collect()} == {k for k in want if k.startswith("c1")} and some <= every
    s.put(row(("x1", "x")))
    assert files_read(s.scan("x")) == files_read(s.scan("x1")) and len(files_read(s.scan("x"))) == 1 < len(files_read(s.get()))
    hit, miss = s.split(row(("x1", ""), ("x9", "")).select("key"))
    assert [tuple(r) for r in hit.collect()] == [("x1", "x")] and [r.key for r in miss.collect()] == ["x9"] and len(files_read(hit)) == 1
    s.put(row(("x1", None)))
    assert s.scan("x1").first().value is None
    s.remove(row(("x1", "")).select("key"))
    assert s.scan("x1").count() == 0


def test_keyed_store_of_two_writers(spark, tmp_path):
    a, b = (stores.text_cache(spark, f"file://{tmp_path}/texts") for _ in range(2))
    a.put(spark.createDataFrame([("k", "first")], "key string, value string"))
    fs, p = b._fs()
    listed, n = fs.listStatus(p), []

    class Late:  # sees the folder as it was before the other writer's put
        exists, create = fs.exists, fs.create

        def listStatus(self, path):
            n.append(1)
            return listed if len(n) == 1 else fs.listStatus(path)

    a.put(spark.createDataFrame([("a", "second")], "key string, value string"))
    own, b._fs = b._fs, lambda: (Late(), p)
    assert b.put(spark.createDataFrame([("b", "third")], "key string, value string")) == 3
    b._fs = own
    assert dict(map(tuple, a.get().collect())) == {"k": "first", "a": "second", "b": "third"}


def test_prompts(spark):
    p = spark.createDataFrame([("grade", 1, "old"), ("grade", 2, "new"), ("other", 1, "x")], "name string, version int, template string")
    assert stores.prompt(p, "grade").first().template == "new" and stores.prompt(p, "grade", 1).first().template == "old" and stores.prompt(p).count() == 2
    for name, version in (("none", None), ("grade", 7)):
        with pytest.raises(KeyError):
            stores.prompt(p, name, version)
    assert spark.range(1).select(stores.render("$a ${b}$$ $a", {"a": F.col("id"), "b": "z"})).first()[0] == "0 z$ 0"
    with pytest.raises(KeyError, match="c"):
        stores.render("$c", {})


def test_traces_floors_and_reports(spark, tmp_path):
    path = f"file://{tmp_path}/traces"
    one = spark.createDataFrame([("q1", "qa")], "question string, task string")
    assert stores.log_traces(one, path) and stores.log_traces(one, path) and spark.read.json(path).count() == 2
    assert not stores.log_traces(one, "nosuchscheme://x/y")
    lines = spark.createDataFrame([(i, '{"q": %d}' % i if i != 8 else "broken") for i in range(10)], "at int, line string")
    assert [r.at for r in stores.recent(lines, ("at",), "line", 3).collect()] == [9, 7]
    floors = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "metric string, floor double")
    stores.write_floors(floors, f"file://{tmp_path}/floors")
    assert sorted(map(tuple, stores.read_floors(spark, f"file://{tmp_path}/floors").collect())) == [("a", 0.25), ("b", 0.5)]
    assert stores.table_report(floors.orderBy("metric"), "T") == "# T\n\n| metric | floor |\n|---|---|\n| a | 0.25 |\n| b | 0.5 |\n"
    with pytest.raises(ValueError):
        stores.table_report(floors, "T", most=1)


def test_upsert_replaces_documents(spark):
    index = spark.createDataFrame([("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z")], "chunk_id string, doc_id string, text string")
    new = spark.createDataFrame([("a1", "a", "n"), ("a1", "a", "n")], "chunk_id string, doc_id string, text string")
    assert sorted(map(tuple, stores.upsert_index(index, new).collect())) == [("a1", "a", "n"), ("b1", "b", "z")]
    taken = spark.createDataFrame([("b1", "c", "w"), ("b1", "d", "v")], "chunk_id string, doc_id string, text string")
    assert sorted(map(tuple, stores.upsert_index(index, taken).collect())) == [("a1", "a", "x"), ("a2", "a", "y"), ("b1", "c", "w")]


def test_two_checkpoints_keep_each_others_rows(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string").coalesce(1)
    rows((1, "a"), (2, "b")).write.parquet(str(tmp_path / "one"))
    rows((3, "c"), (4, "a")).write.parquet(str(tmp_path / "two"))
    table = f"file://{tmp_path}/table"
    assert ingest.recover(spark, table).count() == 0
    for name in ("one", "two", "one"):
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / name))
        ingest.ingest(stream, table, f"file://{tmp_path}/check-{name}").awaitTermination()
    assert sorted(r.doc_id for r in ingest.recover(spark, table).collect()) == [1, 2, 3]
    batch = rows((9, "q"), (10, "r"))
    for _ in range(2):  # a batch that comes again replaces itself
        ingest.put_hashes(batch, table, "x", 0)
    assert sorted(r.doc_id for r in ingest.recover(spark, table).collect()) == [1, 2, 3, 9, 10]


def test_pushed_files_and_dead_letters(spark, tmp_path):
    spark.createDataFrame([("b", "a.pdf", None), (None, None, "bm8="), ("b", "x.txt", None)], "bucket_attr string, object_attr string, data string").coalesce(1).write.parquet(str(tmp_path / "m"))
    files = spark.createDataFrame([("b", "a.pdf", 1, "t"), ("b", "z.pdf", 2, "u")], "bucket string, name string, doc_id long, text string")
    stream = spark.readStream.schema("bucket_attr string, object_attr string, data string").parquet(str(tmp_path / "m"))
    ingest.push_ingest(stream, files, f"file://{tmp_path}/t", f"file://{tmp_path}/dead", f"file://{tmp_path}/c").awaitTermination()
    assert [r.doc_id for r in ingest.recover(spark, f"file://{tmp_path}/t").collect()] == [1]
    assert spark.read.parquet(f"{tmp_path}/dead/*").count() == 1


def test_memory_of_a_stream(spark, tmp_path):
    rows = [(c, k, f"q{k}", "a" * 300) for c in (1, 2) for k in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, q string, a string").coalesce(1).write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema("conv_id long, turn long, q string, a string").parquet(str(tmp_path / "turns"))
    ingest.remember(stream).writeStream.format("memory").queryName("remembered").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.conv_id, r.turn): r.conversation for r in spark.table("remembered").collect()}
    assert got[1, 0] == "" and got[1, 5].startswith("User: q1\nAssistant: " + "a" * 200 + "\nUser: q2") and got[2, 5].count("User:") == 4


def test_xy_cut_against_recursion():
    import random

    def slow(ids, boxes, gap):
        for lo, hi in ((1, 3), (0, 2)):
            groups, reach = [], None
            for i in sorted(ids, key=lambda i: boxes[i][lo]):
                if reach is None or boxes[i][lo] - reach > gap:
                    groups.append([])
                groups[-1].append(i)
                reach = boxes[i][hi] if reach is None else max(reach, boxes[i][hi])
            if len(groups) > 1:
                return [x for g in groups for x in slow(sorted(g), boxes, gap)]
        return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0]))

    rnd = random.Random(6)
    for _ in range(200):
        boxes = [(x, y, x + rnd.randint(5, 80), y + rnd.randint(5, 40)) for x, y in ((rnd.randrange(500), rnd.randrange(800)) for _ in range(rnd.randint(0, 25)))]
        assert layout.xy_cut(boxes, 14) == slow(range(len(boxes)), boxes, 14)
