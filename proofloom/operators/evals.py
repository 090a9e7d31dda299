"""Quality measures over result tables: hits, ranks, recall, citation precision, trajectories and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOL = 1e-9
MARGIN = 0.10
#: The scores that may not fall at all.
DETERMINISTIC = (
    "retrieval.", "trajectory.retrieved_before_answering", "trajectory.citations_attached",
    "trajectory.verification_rail_ran", "trajectory.retry_budget_respected", "trajectory.lane_routed_correctly",
)


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, hit_rank): the 1-based rank of the first result of a gold page, null without one; questions without gold pages are left out."""
    g = gold.select("qid", F.explode("pages").alias("page")).distinct()
    hit = ranked.join(g, ["qid", "page"]).groupBy("qid").agg((F.min("rank") + 1).alias("hit_rank"))
    return g.select("qid").distinct().join(hit, "qid", "left")


def hit_and_mrr(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_rank").isNotNull().cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))


def recall(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, recall) of distinct gold (doc_id, page); null without gold."""
    g = gold.distinct().withColumn("_g", F.lit(1))
    found = g.join(ranked.select("qid", "doc_id", "page").distinct(), ["qid", "doc_id", "page"], "left_semi").groupBy("qid").agg(F.count("*").alias("f"))
    total = gold.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    return ranked.select("qid").distinct().join(total, "qid", "full_outer").join(found, "qid", "left").select("qid", F.round(F.when(F.col("n") > 0, F.coalesce("f", F.lit(0)) / F.col("n")), 6).alias("recall"))


def citation_quality(cited: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, precision, recall) of cited pages: precision is null if none is cited, recall if there is no gold."""
    c, g = cited.select("qid", "page").distinct(), gold.select("qid", "page").distinct()
    both = c.join(g, ["qid", "page"], "left_semi").groupBy("qid").agg(F.count("*").alias("b"))
    n = lambda d, name: d.groupBy("qid").agg(F.count("*").alias(name))
    j = questions.select("qid").join(n(c, "nc"), "qid", "left").join(n(g, "ng"), "qid", "left").join(both, "qid", "left")
    b = F.coalesce("b", F.lit(0))
    return j.select("qid", F.round(F.when(F.col("nc") > 0, b / F.col("nc")), 6).alias("precision"), F.round(F.when(F.col("ng") > 0, b / F.col("ng")), 6).alias("recall"))


def trajectory(out: DataFrame) -> DataFrame:
    """Eight checks of each run as 1, 0 or null (does not apply).

    ``out``: qid, answer, task, expected_lane, computed, n_retrieved, n_cited,
    unverified (null if the check did not run), attempts, n_gold.
    """
    quiet = F.coalesce("answer", F.lit("")).startswith("I couldn't find")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    spoke = lambda c: F.when(~quiet, yes(c))
    return out.select(
        "qid",
        yes(F.col("task").eqNullSafe(F.col("expected_lane"))).alias("lane_routed_correctly"),
        F.when((F.col("task") == "calc") & ~quiet, yes(F.col("computed").isNotNull())).alias("calculator_ran_when_routed"),
        spoke(F.col("n_retrieved") > 0).alias("retrieved_before_answering"),
        spoke(F.col("n_cited") > 0).alias("citations_attached"),
        spoke(F.col("unverified").isNotNull()).alias("verification_rail_ran"),
        F.when(F.col("attempts").isNotNull(), yes(F.col("attempts") <= 3)).alias("retry_budget_respected"),
        F.when(F.col("n_gold") == 0, yes(quiet)).alias("abstained_when_unanswerable"),
        F.when(F.col("n_gold") > 0, yes(~quiet)).alias("answered_when_answerable"),
    )


def means(checks: DataFrame, key: str = "qid") -> DataFrame:
    """(metric, score): the mean of each column over the rows where it applies; columns that never do are left out."""
    names = [c for c in checks.columns if c != key]
    one = checks.agg(*[F.avg(c).alias(c) for c in names])
    return one.unpivot([], names, "metric", "score").filter("score is not null").withColumn("score", F.round("score", 6))


def gate(floors: DataFrame, scores: DataFrame) -> DataFrame:
    """(metric, floor, got, verdict) of (metric, floor) and (metric, got)."""
    j = floors.join(scores, "metric", "full_outer")
    verdict = F.when(F.col("floor").isNull(), "new").when(F.col("got").isNull(), "SKIPPED").when(F.col("got") + TOL < F.col("floor"), "REGRESSED").when(F.col("got") <= F.col("floor") + TOL, "ok").otherwise("IMPROVED")
    return j.select("metric", "floor", "got", verdict.alias("verdict"))


def margin(metric: Column | str) -> Column:
    m = F.col(metric) if isinstance(metric, str) else metric
    exact = F.lit(False)
    for p in DETERMINISTIC:
        exact |= m.startswith(p)
    return F.when(exact, 0.0).otherwise(MARGIN)


def ratchet(floors: DataFrame, scores: DataFrame) -> DataFrame:
    """Floors raised to the scores less their margin, never lowered, cut to four places."""
    j = floors.join(scores, "metric", "full_outer")
    raised = F.greatest(F.col("got") - margin("metric"), F.col("floor"))
    return j.select("metric", (F.floor(raised * 10000) / 10000).alias("floor"))


def category_rates(cases: DataFrame, by: str, hit: str) -> DataFrame:
    return cases.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("hit_rate"))


def share(hit: Column, of: Column) -> Column:
    """Rows of ``of`` that are also ``hit``, over at least one."""
    return F.round(F.count_if(hit & of) / F.greatest(F.count_if(of), F.lit(1)), 6)


def judge_says_correct(verdict: Column) -> Column:
    v = F.lower(verdict)
    return F.contains(v, F.lit("correct")) & ~F.contains(v, F.lit("incorrect"))


def judged(answers: DataFrame, router=None, prompts=None) -> DataFrame:
    """``answers`` (question, reference, answer) with ``correct`` by the model of the role judge; null without one, where it does not answer, and without a reference."""
    if router is None or not router.available("judge"):
        return answers.withColumn("correct", F.lit(None).cast("boolean"))
    from .prompts import Prompts

    text = {c: F.coalesce(c, F.lit("")) for c in ("question", "reference", "answer")}
    verdict = (prompts or Prompts()).ask(router, "judge_correctness", F.col("reference").isNotNull(), **text)
    return answers.withColumn("_v", verdict).withColumn("correct", judge_says_correct(F.col("_v"))).drop("_v")


def seeded_sample(cases: DataFrame, n: int, seed: int = 42, key: str = "qid") -> DataFrame:
    """``n`` rows that depend on the seed and the keys alone."""
    return cases.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
