"""Pages of documents: which parser reads them, what is skipped, and blocks from a text layer.

Input is what any PDF library tells of a page, as tables:

    pages   doc_id, page, width, height, chars (of its text layer, stripped)
    spans   doc_id, page, block, line, seq, text, size, font, flags, x0, y0, x1, y1 (of the block)
    images  doc_id, page, block, x0, y0, x1, y1
    strokes doc_id, page, op
    tables  doc_id, page, content, cells, x0, y0, x1, y1
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.blocks import parser_route
from .layout import block_type, body_size, demote_titles, recursive_order, outside, table_accepted

PAGE = ["doc_id", "page"]
#: Pages sampled for a text layer, and the characters that tell of one.
SAMPLE, ON_ONE, ON_ALL = 14, 150, 600
#: Segments of a ruled table, and the least side of a figure.
SEGMENTS, FIGURE = 6, 40


def parsers(pages: DataFrame) -> DataFrame:
    """``pages`` with ``parser``, by the characters of each."""
    return pages.withColumn("parser", parser_route(F.col("chars")))


def document_parsers(routed: DataFrame) -> DataFrame:
    """(doc_id, parser): the one parser of all pages, or ``mixed``."""
    kinds = F.collect_set("parser")
    return routed.groupBy("doc_id").agg(F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("parser"))


def skipped(routed: DataFrame) -> DataFrame:
    """(doc_id, scanned, skipped_pages) where nothing can read scans: a wholly scanned document is an error, others lose those pages, which are not cached."""
    ocr = F.col("parser") == "ocr"
    out = routed.groupBy("doc_id").agg(F.bool_and(ocr).alias("scanned"), F.sort_array(F.collect_list(F.when(ocr, F.col("page")))).alias("pages"))
    return out.select("doc_id", "scanned", F.when(~F.col("scanned"), F.col("pages")).alias("skipped_pages"))


def dispatched(routed: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Blocks of all pages, each read by the reader that its parser names. A parser without a reader reads nothing."""
    own = [read(routed.filter(F.col("parser") == name)) for name, read in sorted(readers.items())]
    out = own[0]
    for x in own[1:]:
        out = out.unionByName(x)
    return out


def text_layer(pages: DataFrame) -> DataFrame:
    """(doc_id, has_text): from up to 14 pages spread evenly over a document."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    own = pages.select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), n.alias("n"), at.alias("at"))
    # the k-th sampled page is that at k * (n - 1) / 13, halves to the even page
    picked = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE - 1)), lambda k: F.bround(k * (F.col("n") - 1) / F.lit(SAMPLE - 1.0)).cast("int"))
    some = own.filter((F.col("n") <= SAMPLE) | F.array_contains(picked, F.col("at")))
    return some.groupBy("doc_id").agg(((F.max("chars") > ON_ONE) | (F.sum("chars") > ON_ALL)).alias("has_text"))


def may_have_tables(strokes: DataFrame) -> DataFrame:
    """(doc_id, page): pages with enough ruled segments. A line is one, a box (``re``, ``qu``) four."""
    segments = F.sum(F.when(F.col("op") == "l", 1).when(F.col("op").isin("re", "qu"), 4).otherwise(0))
    return strokes.groupBy(*PAGE).agg(segments.alias("n")).filter(F.col("n") >= SEGMENTS).select(*PAGE)


def bold(font: Column, flags: Column) -> Column:
    return (F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(16)) != 0) | F.coalesce(F.lower(font), F.lit("")).rlike("bold|black|heavy")


def extract(pages: DataFrame, spans: DataFrame, images: DataFrame, tables: DataFrame, strokes: DataFrame | None = None, min_gap: float = 10.0) -> DataFrame:
    """Blocks of text-layer pages: doc_id, page, block_id, type, content, size, x0, y0, x1, y1, ord.

    Tables that are accepted (on pages with ruled segments, where ``strokes``
    are given) come first; figures of 40 points or more and texts that no table
    holds follow, as on the page. block_id is the place in that order, ord the
    reading order.
    """
    sizes = pages.select(*PAGE, "width", "height")
    box = ["x0", "y0", "x1", "y1"]
    found = tables.join(sizes, PAGE)
    if strokes is not None:
        found = found.join(may_have_tables(strokes), PAGE, "left_semi")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    found = found.filter(table_accepted(F.col("cells"), area))
    block = lambda df, rank, block, kind, content, size: df.select(*PAGE, F.lit(rank).alias("rank"), F.col(block).cast("long").alias("block"), F.lit(kind).alias("type"), content.alias("content"), size.cast("double").alias("size"), *box)
    own = found.withColumn("block", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "content")))
    out = block(own, 0, "block", "table", F.col("content"), F.lit(None))
    figures = images.filter((F.col("x1") - F.col("x0") >= FIGURE) & (F.col("y1") - F.col("y0") >= FIGURE))
    out = out.unionByName(block(outside(figures, found, PAGE), 1, "block", "figure", F.lit(""), F.lit(None)))
    lines = spans.groupBy(*PAGE, "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("text"))
    lines = lines.filter(strip(F.col("text")) != "").groupBy(*PAGE, "block").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")).alias("content"))
    seen = spans.filter(strip(F.col("text")) != "")
    style = seen.groupBy(*PAGE, "block").agg(F.max("size").alias("size"), F.max(bold(F.col("font"), F.col("flags"))).alias("bold"), *[F.first(c).alias(c) for c in box])
    texts = outside(lines.join(style, [*PAGE, "block"]), found, PAGE)
    body = body_size(seen.withColumn("text", strip(F.col("text"))), PAGE)
    texts = texts.join(body, PAGE, "left").join(sizes, PAGE)
    kind = block_type(F.col("content"), F.col("size"), F.col("body_size"), F.col("bold"), F.col("y1"), F.col("height"))
    titled = demote_titles(texts.withColumn("type", kind), PAGE)
    out = out.unionByName(titled.select(*PAGE, F.lit(1).alias("rank"), F.col("block").cast("long").alias("block"), "type", "content", F.col("size").cast("double").alias("size"), *box))
    out = out.withColumn("block_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy("rank", "block")) - 1).drop("rank", "block")
    placed = recursive_order(out, PAGE, min_gap, tie="block_id").select(*PAGE, "block_id", "ord")
    return out.join(placed, [*PAGE, "block_id"], "left")
