"""Citations and figures: validation, snapping, verification, verified figures and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPARED_FIGURE, figures, has_figure, is_year, near, unit_after, without_commas


def validate(citations: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Citations (keys, page, block_id) of evidence that was retrieved; a citation of a whole page needs a block of it.

    With ``doc_id`` among the keys documents are kept apart.
    """
    block = citations.filter(F.col("block_id").isNotNull()).join(evidence.select(*keys, "page", "block_id"), [*keys, "page", "block_id"], "left_semi")
    page = citations.filter(F.col("block_id").isNull()).join(evidence.select(*keys, "page"), [*keys, "page"], "left_semi")
    return block.unionByName(page)


def snap(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each citation (qid, claim, cite, page, block_id, text) at the block of its page that has the claim's figures.

    The most values win, then the most figures, then the cited block, then the
    first; a claim without figures, or a page without evidence, keeps its
    block; years alone keep it; no figure found leaves the page. Citations that
    become equal are one.
    """
    c = claims.withColumn("nums", figures("text")).withColumn("vals", F.filter("nums", lambda n: ~is_year(n)))
    text = without_commas(F.coalesce(F.col("e.content"), F.lit("")))
    joined = c.alias("c").join(evidence.alias("e"), (F.col("c.qid") == F.col("e.qid")) & (F.col("c.page") == F.col("e.page")), "left")
    score = F.struct(
        F.size(F.filter("c.vals", lambda n: has_figure(text, n))).alias("v"), F.size(F.filter("c.nums", lambda n: has_figure(text, n))).alias("a"),
        F.col("e.block_id").eqNullSafe(F.col("c.block_id")).cast("int").alias("cited"), (-F.col("e.pos")).alias("first"),
    )
    best = joined.groupBy("c.qid", "c.claim", "c.cite").agg(
        F.first("c.page").alias("page"), F.first("c.block_id").alias("cited"), F.first(F.size("c.nums")).alias("n"), F.first(F.size("c.vals")).alias("nv"),
        F.max(F.when(F.col("e.qid").isNotNull(), score)).alias("s"), F.max_by("e.block_id", F.when(F.col("e.qid").isNotNull(), score)).alias("b"),
    )
    to = F.when((F.col("n") == 0) | F.col("s").isNull(), F.col("cited")).when(F.col("s.v") > 0, F.col("b")).when((F.col("s.a") > 0) & (F.col("nv") == 0), F.col("cited"))
    out = best.select("qid", "claim", "cite", "page", to.alias("block_id"))
    order = Window.partitionBy("qid", "claim", "page", "block_id").orderBy("cite")
    return out.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def cited_texts(citations: DataFrame, evidence: DataFrame, parents: bool = True, pages: bool = True) -> DataFrame:
    """(qid, claim, shown): what the citations of a claim show, without commas. The last of several rows of a block counts."""
    shown = F.concat_ws(" ", F.nullif("content", F.lit("")), *([F.nullif("parent_text", F.lit(""))] if parents else []))
    ev = evidence.groupBy("qid", "page", "block_id").agg(F.max_by(without_commas(shown), "pos").alias("shown"))
    on = (F.col("c.qid") == F.col("e.qid")) & (F.col("c.page") == F.col("e.page"))
    block = citations.filter("block_id is not null").alias("c").join(ev.alias("e"), on & (F.col("c.block_id") == F.col("e.block_id"))).select("c.qid", "c.claim", "e.shown")
    if pages:
        block = block.union(citations.filter("block_id is null").alias("c").join(ev.alias("e"), on).select("c.qid", "c.claim", "e.shown"))
    return block.groupBy("qid", "claim").agg(F.array_join(F.sort_array(F.collect_list("shown")), " ").alias("shown"))


def check(claims: DataFrame, citations: DataFrame, evidence: DataFrame, computed: str | None = None) -> DataFrame:
    """(qid, claim, verified, unverified): whether a claim is cited and every figure but years is shown there or is near the computation.

    ``computed`` is a column of ``claims`` (a number or null).
    """
    cited = citations.groupBy("qid", "claim").agg(F.count("*").alias("n"))
    own = claims.join(cited, ["qid", "claim"], "left").join(cited_texts(citations, evidence), ["qid", "claim"], "left")
    shown = F.coalesce("shown", F.lit(""))
    close = lambda n: F.coalesce(near(n.cast("double"), F.col(computed).cast("double")), F.lit(False)) if computed else F.lit(False)
    bad = F.filter(figures("text"), lambda n: ~is_year(n) & ~has_figure(shown, n) & ~close(n))
    return own.select("qid", "claim", ((F.coalesce("n", F.lit(0)) > 0) & (F.size(bad) == 0)).alias("verified"), bad.alias("unverified"))


def unsupported(answer: Column | str, shown: Column | str, computed: Column | None = None) -> Column:
    """Distinct figures of an answer, page marks left out, that its evidence does not show."""
    answer = F.regexp_replace(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")), r"(?i)\[page\s+[0-9]+\]", "")
    shown = without_commas(F.coalesce(F.col(shown) if isinstance(shown, str) else shown, F.lit("")))
    close = lambda n: F.coalesce(near(n.cast("double"), computed), F.lit(False)) if computed is not None else F.lit(False)
    return F.filter(F.array_distinct(figures(answer)), lambda n: ~is_year(n) & ~has_figure(shown, n) & ~close(n))


def verified_figures(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, value, raw, unit, page, block_id, text): the first figure, claims in order, that a cited block itself shows."""
    own = claims.join(cited_texts(citations, evidence, parents=False, pages=False), ["qid", "claim"])
    parts = F.split("text", COMPARED_FIGURE, -1)
    found = own.select("qid", "claim", "text", "shown", parts.alias("gaps"), F.regexp_extract_all("text", F.lit(COMPARED_FIGURE), F.lit(0)).alias("raws"))
    found = found.select("*", F.posexplode("raws").alias("i", "raw")).withColumn("tok", without_commas(F.col("raw"))).filter(~is_year(F.col("tok")) & has_figure(F.col("shown"), F.col("tok")))
    lengths = lambda a: F.aggregate(F.transform(a, F.length), F.lit(0), lambda s, x: s + x)
    end = lengths(F.slice("gaps", F.lit(1), F.col("i") + 1)) + lengths(F.slice("raws", F.lit(1), F.col("i") + 1))
    first = citations.groupBy("qid", "claim").agg(F.min_by(F.struct("page", "block_id"), "cite").alias("at"))
    one = found.withColumn("unit", unit_after(F.col("text"), end)).withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("claim", "i"))).filter("_r = 1")
    return one.join(first, ["qid", "claim"]).select("qid", F.col("tok").cast("double").alias("value"), "raw", "unit", "at.page", "at.block_id", F.left("text", F.lit(160)).alias("text"))


def delta(current: Column, prior: Column) -> dict[str, Column]:
    """Absolute and per-cent change and its direction; per cent is null where the prior value is 0."""
    d = current - prior
    return {"abs": d, "pct": F.when(prior != 0, F.try_divide(d, prior) * 100), "direction": F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "flat")}


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sides (heading, value, unit) by heading: status and, where both have one unit, the change from b to a."""
    j = a.alias("a").join(b.alias("b"), F.col("a.heading") == F.col("b.heading"), "full_outer")
    va, vb = F.col("a.value"), F.col("b.value")
    same = F.col("a.unit") == F.col("b.unit")
    status = F.when(va.isNull() & vb.isNull(), "not_disclosed").when(va.isNull() | vb.isNull(), "partial").when(same, "compared").otherwise("unit_mismatch")
    d = {k: F.when(same, v) for k, v in delta(va, vb).items()}
    return j.select(F.coalesce("a.heading", "b.heading").alias("heading"), status.alias("status"), d["abs"].alias("abs"), d["pct"].alias("pct"), d["direction"].alias("direction"))
