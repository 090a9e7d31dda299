"""Sections and chunks from ordered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .layout import FURNITURE


def chunks(blocks: DataFrame) -> DataFrame:
    """One chunk for each title and each block with content, with its section, heading and parent text.

    ``blocks``: doc_id, page, seq, block_id, type, content, ord. A title opens a
    section, and so does the first block of a page; headings do not reach over
    a page. Parent text is the section's, 1,500 characters at most.
    """
    flow = blocks.filter(~F.col("type").isin(*FURNITURE)).withColumn("c", strip(F.coalesce("content", F.lit(""))))
    doc = Window.partitionBy("doc_id").orderBy("page", F.coalesce("ord", F.lit(1_000_000_000)), "seq")
    flow = flow.withColumn("rn", F.row_number().over(doc)).filter((F.col("type") == "title") | (F.col("c") != ""))
    page = Window.partitionBy("doc_id", "page").orderBy("rn")
    title = F.col("type") == "title"
    flow = flow.withColumn("opens", F.when(title | (F.row_number().over(page) == 1), 1).otherwise(0))
    flow = flow.withColumn("hd", F.last(F.when(title & (F.col("c") != ""), F.col("c")), True).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    flow = flow.withColumn("section_id", (F.sum("opens").over(Window.partitionBy("doc_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    sections = flow.groupBy("doc_id", "section_id").agg(
        F.max(F.when(F.col("opens") == 1, F.coalesce("hd", F.lit("(top)")))).alias("section_heading"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rn", "c"))), lambda x: x["c"] != ""), lambda x: x["c"]), "\n").alias("section_text"),
    )
    text = F.when(title, F.col("c")).when(F.col("hd").isNull(), F.col("c")).otherwise(F.concat(F.col("hd"), F.lit("\n"), F.col("c")))
    return flow.join(sections, ["doc_id", "section_id"]).select(
        F.concat_ws(":", "doc_id", "page", "block_id").alias("chunk_id"), "doc_id", "page", "block_id", "section_id", "type",
        F.coalesce("hd", F.lit("(top)")).alias("heading"), text.alias("text"), F.col("c").alias("content"), F.left("section_text", F.lit(1500)).alias("parent_text"), "section_heading",
    )


def doc_labels(blocks: DataFrame) -> DataFrame:
    """(doc_id, label): a document's first title with content, 120 characters at most."""
    titles = blocks.filter((F.col("type") == "title") & (strip(F.coalesce("content", F.lit(""))) != ""))
    return titles.groupBy("doc_id").agg(F.left(F.min_by(strip(F.col("content")), F.struct("page", F.coalesce("ord", F.lit(1_000_000_000)), "seq")), F.lit(120)).alias("label"))


def doc_stats(blocks: DataFrame, made: DataFrame) -> DataFrame:
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "table").alias("n_tables"))
    c = made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("section_id").alias("n_sections"))
    return b.join(c, "doc_id", "left").select("doc_id", "n_blocks", "n_tables", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


def context_keys(made: DataFrame, labels: DataFrame) -> DataFrame:
    """Cache keys of the chunks that a context provider would describe: tables, and others of 60 characters or more."""
    wanted = made.filter((F.col("type") == "table") | (F.length("content") >= 60)).join(labels, "doc_id", "left")
    key = F.concat(F.lit("ctx1:"), F.left(F.sha2(F.concat_ws("|", F.coalesce("label", F.lit("")), "heading", "content"), 256), F.lit(32)))
    return wanted.select("chunk_id", key.alias("cache_key"), F.left("content", F.lit(1200)).alias("excerpt"))
