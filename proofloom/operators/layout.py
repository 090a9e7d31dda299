"""Layout: gap groups, reading order, overlap, repeated furniture, title rules and table gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

FURNITURE = ("header", "footer", "page_number")


def gap_groups(rows: DataFrame, by: list[str], low: str, high: str, min_gap: float, tie: str, name: str = "gap_group") -> DataFrame:
    """Number the runs along one axis: a row starts a new run if it begins over ``min_gap`` after all before it end."""
    order = Window.partitionBy(*by).orderBy(low, tie)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when(F.col(low) - reach > min_gap, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def reading_order(blocks: DataFrame, by: list[str], min_gap: float = 14.0, tie: str = "seq") -> DataFrame:
    """``ord`` (0-based) of non-furniture blocks: horizontal bands, then columns within a band, then top-left first."""
    flow = blocks.filter(~F.col("type").isin(*FURNITURE))
    banded = gap_groups(flow, by, "y0", "y1", min_gap, tie, "band")
    cols = gap_groups(banded, [*by, "band"], "x0", "x1", min_gap, tie, "col")
    return cols.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy("band", "col", "y0", "x0", tie)) - 1)


def xy_cut(boxes: list[tuple[float, float, float, float]], min_gap: float) -> list[int]:
    """Positions of boxes (x0, y0, x1, y1) in reading order by recursive cuts: bands, else columns, else top-left first."""

    def cut(ids: list[int], lo: int, hi: int) -> list[list[int]]:
        groups: list[list[int]] = []
        reach = None
        for i in sorted(ids, key=lambda i: boxes[i][lo]):
            if reach is None or boxes[i][lo] - reach > min_gap:
                groups.append([])
            groups[-1].append(i)
            reach = boxes[i][hi] if reach is None else max(reach, boxes[i][hi])
        return groups

    out: list[int] = []
    todo = [list(range(len(boxes)))]
    while todo:
        ids = todo.pop()
        for lo, hi in ((1, 3), (0, 2)):
            groups = cut(ids, lo, hi) if len(ids) > 1 else [ids]
            if len(groups) > 1:
                todo.extend(reversed(groups))
                break
        else:
            out.extend(sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0])))
    return out


def xy_cuts(page: np.ndarray, boxes: np.ndarray, min_gap: float) -> np.ndarray:
    """The boxes (rows x0, y0, x1, y1) of many pages in the order of :func:`xy_cut`, page by page: all groups are cut at once, level by level."""
    n = len(boxes)
    group, axis = page.astype(np.int64), np.ones(n, np.int8)  # a group is to be cut into bands (1), then columns (0), or is whole (2)
    _, group = np.unique(group, return_inverse=True)
    live = np.arange(n)
    while len(live):
        g, ax = group[live], axis[live]
        low, high = boxes[live, ax], boxes[live, ax + 2]
        order = np.lexsort((live, low, g))
        g, low, high = g[order], low[order], high[order]
        first = np.append(True, g[1:] != g[:-1])
        # running maximum within a group: of ranks, lifted above those of all groups before
        rank = np.empty(len(g), np.int64)
        by_high = np.argsort(high, kind="stable")
        rank[by_high] = np.arange(len(g))
        most = np.maximum.accumulate((np.cumsum(first) - 1) * len(g) + rank) % len(g)
        reach = high[by_high[most]]
        opens = ~first
        opens[1:] &= low[1:] - reach[:-1] > min_gap
        cuts = np.add.reduceat(opens, np.flatnonzero(first))
        which = np.cumsum(first) - 1
        cut = cuts[which] > 0
        run = np.cumsum(opens) - np.cumsum(opens)[first][which]
        at = live[order]
        # a group of k runs takes k numbers, so all groups after it move on
        shift = np.zeros(group.max() + 2, np.int64)
        np.add.at(shift, g[first] + 1, cuts)
        moved = np.cumsum(shift)
        group += moved[group]
        group[at] += run
        axis[at] = np.where(cut, 1, np.where(axis[at] == 1, 0, 2))
        live = np.flatnonzero(axis < 2)
    return np.lexsort((np.arange(n), boxes[:, 0], boxes[:, 1], group))


def recursive_order(blocks: DataFrame, by: list[str], min_gap: float = 14.0, tie: str = "seq") -> DataFrame:
    """``ord`` by cuts to any depth. A page's boxes are one array, which a page bounds; the pages of a batch are cut together."""

    @F.pandas_udf("array<int>")
    def places(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        sizes = x0.map(len).to_numpy(np.int64)
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        boxes = np.stack([np.concatenate(c.to_numpy()).astype(np.float64) for c in (x0, y0, x1, y1)], axis=1)
        starts = np.append(0, np.cumsum(sizes))
        page = np.repeat(np.arange(len(sizes)), sizes)
        if np.isnan(boxes).any():  # boxes without an edge are compared one by one
            return pd.Series([xy_cut([tuple(b) for b in boxes[i:j].tolist()], min_gap) for i, j in zip(starts, starts[1:])])
        order = xy_cuts(page, boxes, min_gap) - starts[page]
        return pd.Series(np.split(order.astype(np.int32), starts[1:-1]))

    flow = blocks.filter(~F.col("type").isin(*FURNITURE))
    rest = [c for c in flow.columns if c not in by]
    pages = flow.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(tie, *[c for c in rest if c != tie]))).alias("_b"))
    edges = [F.col(f"_b.{c}").cast("array<double>") for c in ("x0", "y0", "x1", "y1")]
    ordered = pages.withColumn("_o", places(*edges)).select(*by, "_b", F.posexplode("_o").alias("ord", "_i"))
    return ordered.select(*by, F.get("_b", F.col("_i")).alias("_x"), "ord").select(*by, *[F.col(f"_x.{c}").alias(c) for c in rest], "ord")


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How much of box a lies in box b."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])
    return w * h / F.greatest(F.lit(1.0), area)


def outside(blocks: DataFrame, rects: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """Blocks of which no rectangle of the same page holds more than ``share``."""
    a, b = blocks.alias("a"), rects.alias("b")
    side = lambda t: {k: F.col(f"{t}.{k}") for k in ("x0", "y0", "x1", "y1")}
    on = overlap_share(side("a"), side("b")) > share
    for k in by:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, on, "left_anti")


def furniture_key(text: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(strip(text)), "[0-9]+", "#"), F.lit(60))


def band(y0: Column, y1: Column, height: Column) -> Column:
    return F.when(y1 <= 0.10 * height, "top").when(y0 >= 0.90 * height, "bottom")


def mark_furniture(blocks: DataFrame, height: float = 842.0) -> DataFrame:
    """Blocks that stand in the same band of many pages of a document become headers and footers and lose their order.

    Needs four pages; then as many blocks as 30 % of the pages, three at least.
    Blocks count, not pages.
    """
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    keyed = blocks.withColumn("key", furniture_key(F.col("content"))).withColumn("band", band(F.col("y0"), F.col("y1"), F.lit(height)))
    often = keyed.filter(F.col("band").isNotNull() & (F.col("key") != "")).groupBy("doc_id", "key", "band").agg(F.count("*").alias("n"))
    often = often.join(pages, "doc_id").filter((F.col("n_pages") >= 4) & (F.col("n") >= F.greatest(F.lit(3), F.floor(0.3 * F.col("n_pages"))))).select("doc_id", "key", "band", F.lit(True).alias("rep"))
    kind = F.when(F.col("rep") & (F.col("band") == "top"), "header").when(F.col("rep"), "footer").otherwise(F.col("type"))
    return keyed.join(often, ["doc_id", "key", "band"], "left").withColumn("type", kind).withColumn("ord", F.when(F.col("rep").isNull(), F.col("ord"))).drop("key", "band", "rep")


def body_size(spans: DataFrame, by: list[str]) -> DataFrame:
    """The commonest font size, rounded to half points and weighted by characters; the first seen wins a tie."""
    sizes = spans.select(*by, (F.bround(F.col("size") * 2) / 2).alias("size"), F.length("text").alias("n"), "seq").groupBy(*by, "size").agg(F.sum("n").alias("n"), F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first", "size"))
    return sizes.withColumn("_r", rank).filter("_r = 1").select(*by, F.col("size").alias("body_size"))


def block_type(content: Column, size: Column, body: Column, bold: Column, y1: Column, height: Column) -> Column:
    text = strip(content)
    plain = size.isNull() | body.isNull() | text.contains("\n") | (F.length(text) > 90) | text.rlike(r"[.,;:]$")
    return F.when((y1 >= 0.94 * height) & (F.length(text) < 80), "footer").when(plain, "text").when((size >= 1.20 * body) | (bold & (size >= 1.12 * body)), "title").otherwise("text")


def demote_titles(blocks: DataFrame, by: list[str]) -> DataFrame:
    """On pages with over four titles, those under 0.92 of the largest size are text."""
    page = Window.partitionBy(*by)
    title = F.col("type") == "title"
    n, top = F.count_if(title).over(page), F.max(F.when(title, F.col("size"))).over(page)
    return blocks.withColumn("type", F.when(title & (n > 4) & (F.col("size") < 0.92 * top), "text").otherwise(F.col("type")))


NUMBER_TOKEN = r"[-(]?[0-9][0-9,.]*\)?%?"


def borderless_table(content: Column) -> Column:
    """Four or more lines that are not blank, of which half or more have two numbers."""
    lines = F.filter(F.split(content, "\n"), lambda x: strip(x) != "")
    numeric = F.filter(lines, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w.rlike(f"^{NUMBER_TOKEN}$"))) >= 2)
    return F.coalesce((F.size(lines) >= 4) & (F.size(numeric) >= 0.5 * F.size(lines)), F.lit(False))


def table_accepted(cells: Column, area_share: Column) -> Column:
    """``cells``: rows of strings. Two by two at least, not the whole page, enough numbers."""
    flat = F.filter(F.flatten(cells), lambda c: F.coalesce(strip(c), F.lit("")) != "")
    share = F.size(F.filter(flat, lambda c: strip(c).rlike(r"^[-(]?[0-9][0-9,.\s]*\)?%?$"))) / F.greatest(F.size(flat), F.lit(1))
    return (F.size(cells) >= 2) & (F.array_max(F.transform(cells, lambda r: F.size(r))) >= 2) & (area_share <= 0.85) & (share >= 0.15)


def enrich_selection(blocks: DataFrame, cap: int = 40) -> DataFrame:
    """The first ``cap`` blocks of a document that a vision provider should read: empty figures and unruled tables."""
    need = F.when((F.col("type") == "figure") & (strip(F.coalesce("content", F.lit(""))) == ""), "figure").when((F.col("type") == "text") & borderless_table(F.col("content")), "table")
    wanted = blocks.withColumn("need", need).filter(F.col("need").isNotNull() & (F.col("x1") - F.col("x0") >= 30) & (F.col("y1") - F.col("y0") >= 20))
    return wanted.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq"))).filter(F.col("_r") <= cap).drop("_r")
