"""Blocks from texts, HTML and Markdown; caches, registries, envelopes and benchmark files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

LINES_A_PAGE = 40


def line_blocks(docs: DataFrame) -> DataFrame:
    """A block for each line of a document that is not blank: 40 lines a page, short first lines as titles."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "content")).filter(strip(F.col("content")) != "")
    y = (F.col("seq") % LINES_A_PAGE) * 20.0
    kind = F.when((F.length("content") <= 60) & (F.col("seq") % 8 == 0), "title").otherwise("text")
    return lines.select(
        "doc_id", (F.floor(F.col("seq") / LINES_A_PAGE) + 1).cast("int").alias("page"), "seq", F.col("seq").alias("block_id"), kind.alias("type"), "content",
        F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(545.0).alias("x1"), (y + 12.0).alias("y1"), F.col("seq").alias("ord"),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """Titles, paragraphs, menus and footers of pages, by their tags; entities decoded for the five that mark-up needs."""
    tags = F.regexp_extract_all("html", F.lit(r"(?s)<(h1|p|nav|footer)>(.*?)(?=</?(?:h1|p|nav|footer|article)>)"), F.lit(1))
    inner = F.regexp_extract_all("html", F.lit(r"(?s)<(h1|p|nav|footer)>(.*?)(?=</?(?:h1|p|nav|footer|article)>)"), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("inner"))).alias("seq", "b"))
    text = F.regexp_replace(F.col("b.inner"), "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    kind = F.when(F.col("b.tag") == "h1", "title").when(F.col("b.tag") == "nav", "header").when(F.col("b.tag") == "footer", "footer").otherwise("text")
    return rows.select("page_id", "seq", kind.alias("type"), strip(F.regexp_replace(text, r"\s+", " ")).alias("content")).filter("content <> ''")


def markdown_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Titles, tables and paragraphs of Markdown: (key, block_id, type, content)."""
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line")).withColumn("s", strip(F.col("line")))
    row = F.col("s").startswith("|") & (F.length("s") - F.length(F.replace("s", F.lit("|"), F.lit(""))) >= 2)
    lines = lines.withColumn("kind", F.when(row, "table").when(F.col("s").startswith("#"), "title").when(F.col("s") == "", "blank").otherwise("text"))
    order = Window.partitionBy(key).orderBy("pos")
    new = (F.col("kind") == "title") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    lines = lines.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kind <> 'blank'")
    piece = F.when(F.col("kind") == "table", F.col("s")).when(F.col("kind") == "title", strip(F.regexp_replace("s", "^[# ]+", ""))).otherwise(F.col("line"))
    joined = lines.withColumn("piece", piece).groupBy(key, "run", F.col("kind").alias("type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "\n").alias("content"))
    joined = joined.withColumn("content", strip(F.col("content"))).filter("content <> ''")
    return joined.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).alias("block_id"), "type", "content")


def content_hash(c: Column | str) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def unseen(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """One document for each content hash that the registry has neither ready nor parsing; the smallest doc_id of a hash stays."""
    hashed = docs.withColumn("doc_hash", content_hash(F.coalesce("text", F.lit(""))))
    first = hashed.groupBy("doc_hash").agg(F.min("doc_id").alias("doc_id"))
    return first.join(registry.filter(F.col("status").isin("ready", "parsing")), "doc_hash", "left_anti")


def cache_split(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with ``hit``: whether the cache has its key."""
    return wanted.join(cache.select(*keys, F.lit(True).alias("_hit")).distinct(), keys, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), version).alias("_x")).select(*keys, "_x.*")


def parser_route(chars: Column) -> Column:
    return F.when(chars > 50, "textlayer").otherwise("ocr")


def push_target(message: DataFrame) -> DataFrame:
    """bucket and name of push messages (bucket_attr, object_attr, data): attributes first, then base64 JSON; verdict take, ack or reject."""
    body = F.from_json(F.unbase64("data").cast("string"), "bucket string, name string")
    out = message.withColumn("bucket", F.coalesce("bucket_attr", body["bucket"])).withColumn("name", F.coalesce("object_attr", body["name"]))
    verdict = F.when(F.col("bucket").isNull() | F.col("name").isNull(), "reject").when(F.lower("name").endswith(".pdf"), "take").otherwise("ack")
    return out.withColumn("verdict", verdict)


def longest_prefix(cases: DataFrame, stems: DataFrame) -> DataFrame:
    """``cases`` (qid) with the longest file stem that, with an underscore, begins the id: what stands before each of its underscores is looked up."""
    pieces = F.split("qid", "_")
    before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "_"))
    tried = cases.select("qid").distinct().filter(F.contains("qid", F.lit("_"))).select("qid", F.explode(before).alias("stem"))
    found = tried.join(stems.select("stem").distinct(), "stem").groupBy("qid").agg(F.max_by("stem", F.length("stem")).alias("stem"))
    return cases.join(found, "qid", "left")


def page_numbers(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
