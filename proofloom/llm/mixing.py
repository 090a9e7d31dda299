"""Mixing sources to target weights.

Weights are the sources' token shares raised to an exponent and normalised. The
exponent is bisected (each step evaluates a grid of points in one aggregate over
the source table) until the weights' entropy, or the repetition of the most
repeated source, meets its target. A source's token budget is then spent on
epochs: whole passes over its documents, and a last pass over blocks in a keyed
order until the budget is used. Blocks are hash classes of a source's documents,
``BLOCKS`` for each source. The one block where the budget runs out is cut by a
key: sums over 65536 parts of the block in key order tell the part, and sums
over the keys of that part the last key that is used. Both passes read ids and
counts only; texts are never moved, each row then decides by its own key.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCKS = 256
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_key(source: str = "source") -> Column:
    """A key that tells null from every source."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def exponent(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = None, points: int = 32, rounds: int = 8) -> float:
    """The exponent for which the weights over ``totals`` (tokens > 0) meet a target.

    ``entropy`` (nats) falls as the exponent grows from 0 (all sources alike);
    out of reach, the nearest end of 0 to 8 is taken. ``max_repeats`` bounds how
    often the most repeated source is passed over while the least repeated is
    passed over once; the smallest exponent in 0 to 1 that keeps it is taken.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("one target is needed")
    total = totals.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total[0]:
        return 1.0
    p = F.col("tokens") / F.lit(total[0])
    lo, hi = 0.0, 8.0 if max_repeats is None else 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * k / points for k in range(points + 1)]
        if max_repeats is None:
            sums = totals.agg(*[e for a in grid for e in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]).first()
            over = [log(sums[2 * k]) - a * sums[2 * k + 1] / sums[2 * k] > entropy for k, a in enumerate(grid)]
        else:
            over = [(total[2] / total[1]) ** (1 - a) > max_repeats for a in grid]
        first = next((k for k, x in enumerate(over) if not x), None)
        if first is None:
            return hi
        if first == 0:
            return lo
        lo, hi = grid[first - 1], grid[first]
    return hi


def source_budgets(totals: DataFrame, power: float, budget: float | None = None) -> DataFrame:
    """``totals`` (skey, tokens) with weight and budget in tokens; no ``budget``: the least that passes once over every source."""
    p = F.pow(F.col("tokens").cast("double"), F.lit(power))
    norm = totals.agg(F.sum(p), F.max(F.col("tokens") / p)).first()
    spend = budget if budget is not None else (norm[1] or 0.0) * (norm[0] or 0.0)
    weight = p / F.lit(norm[0] or 1.0)
    return totals.withColumns({"weight": weight, "budget": weight * F.lit(float(spend))})


def mixed(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: str = "mix", text: str = "text") -> DataFrame:
    """A row for each time a row of ``docs`` is used: struct ``row`` (its columns), n_tokens, skey, weight, epoch, block, place.

    ``place`` orders a source's rows within an epoch and block. A source whose
    documents have no tokens costs nothing and is used once. Null source: a
    source of its own. Null text: no tokens, and equal to the empty one. Rows of
    equal doc_id and text are used alike, also where the budget ends among them.
    Extra columns may have any name. Empty input: no rows.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = _digest(F.lit(seed), "doc_id", f"`{text}`")
    parts = [source_key().alias("skey"), key.alias("key"), n_tokens(text).alias("n_tokens")]
    block = F.pmod(_number(F.col("key")), F.lit(BLOCKS)).cast("int").alias("block")
    keyed = saved(docs.select(*parts).select("*", block), "keyed")
    blocks = saved(keyed.groupBy("skey", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = saved(blocks.groupBy("skey").agg(F.sum("tokens").alias("tokens")), "sources")
    some = totals.filter("tokens > 0")
    power = exponent(some, entropy, max_repeats)
    budgets = source_budgets(some, power, budget).select("skey", "weight", (F.col("budget") / F.col("tokens")).alias("passes"), "budget", F.col("tokens").alias("of_source"))
    # passes are rounded before they are cut, so that a budget of exactly one pass is one pass
    full = F.floor(F.round("passes", 9))
    order = Window.partitionBy("skey").orderBy(_digest(F.lit(seed), "skey", "full", "block"), "block")
    plan = (
        blocks.join(budgets, "skey", "left")
        .withColumn("full", F.coalesce(full, F.lit(1)).cast("int"))
        .withColumn("rest", F.coalesce(F.round("passes", 9) - F.col("full"), F.lit(0.0)) * F.coalesce("of_source", F.lit(0)))
        .withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("skey", "block", "weight", "full", F.greatest(F.lit(0.0), F.least(F.col("rest") - F.col("before"), F.col("tokens").cast("double"))).alias("left"), F.col("tokens").alias("of_block"))
    )
    plan = saved(plan, "plan")
    last = _last_keys(keyed, plan.filter("left > 0 and left < of_block"), seed)
    plan = saved(plan.join(last, ["skey", "block"], "left"), "plan")
    place = lambda epoch: _digest(F.lit(seed), epoch, "key")
    more = F.when(F.col("left") <= 0, 0).when(F.col("left") >= F.col("of_block"), 1).otherwise((place("full") <= F.col("last_place")).cast("int"))
    own = docs.select(F.struct(*names).alias("row"), *parts).select("*", block)
    used = own.join(plan, ["skey", "block"]).withColumn("uses", F.col("full") + more).filter("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    return used.select("row", "n_tokens", "skey", "weight", "epoch", "block", place("epoch").alias("place"))


def _last_keys(keyed: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """(skey, block, last_place): of each cut block (one a source at most), the last place whose tokens before it are under ``left``."""
    before = lambda by: F.coalesce(F.sum("tokens").over(Window.partitionBy("skey", "block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = keyed.join(cuts.select("skey", "block", "full", "left"), ["skey", "block"]).select("skey", "block", "left", "n_tokens", _digest(F.lit(seed), "full", "key").alias("place"))
    inner = inner.withColumn("part", F.substring("place", 1, 4))
    sums = inner.groupBy("skey", "block", "left", "part").agg(F.sum("n_tokens").alias("tokens")).withColumn("before", before("part")).filter("before < left")
    part = saved(sums.groupBy("skey", "block").agg(F.max(F.struct("part", (F.col("left") - F.col("before")).alias("rest"))).alias("x")).select("skey", "block", "x.*"), "cut")
    keys = inner.drop("left").join(part, ["skey", "block", "part"]).groupBy("skey", "block", "rest", "place").agg(F.sum("n_tokens").alias("tokens"))
    return keys.withColumn("before", before("place")).filter("before < rest").groupBy("skey", "block").agg(F.max("place").alias("last_place"))


#: DuckDB's form of the registered query: with a repetition limit the exponent has a closed form.
ORACLE = r"""
WITH d AS (SELECT doc_id, text, coalesce('=' || source, 'null') AS skey,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens,
                  md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key,
                  CAST(('0x' || substr(key, 1, 8))::BIGINT % 256 AS INTEGER) AS block
           FROM documents),
b AS (SELECT skey, block, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY 1, 2),
t AS (SELECT skey, sum(tokens)::BIGINT AS tokens FROM b GROUP BY 1),
x AS (SELECT greatest(0, 1 - ln({repeats}) / nullif(ln(max(tokens)::DOUBLE / min(tokens)), 0)) AS a FROM t WHERE tokens > 0),
w AS (SELECT skey, tokens, pow(tokens::DOUBLE, coalesce(a, 0)) AS p FROM t, x WHERE tokens > 0),
n AS (SELECT sum(p) AS s, max(tokens / p) AS m FROM w),
g AS (SELECT skey, p / s AS weight, round(p * m / tokens, 9) AS passes, tokens AS of_source FROM w, n),
f AS (SELECT b.*, weight, coalesce(floor(passes), 1)::INTEGER AS "full", coalesce(passes - floor(passes), 0) * coalesce(of_source, 0) AS rest
      FROM b LEFT JOIN g USING (skey)),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY skey ORDER BY md5('mix|' || skey || '|' || "full" || '|' || block), block
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
q AS (SELECT skey, block, weight, "full", greatest(0, least(rest - before, tokens)) AS lft, tokens AS of_block FROM o),
i AS (SELECT d.*, weight, "full", lft, of_block, md5('mix|' || "full" || '|' || key) AS last_place FROM d JOIN q USING (skey, block)),
j AS (SELECT *, sum(n_tokens) OVER (PARTITION BY skey, block ORDER BY last_place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                - sum(n_tokens) OVER (PARTITION BY skey, block, last_place) AS used FROM i),
u AS (SELECT *, "full" + CASE WHEN lft <= 0 THEN 0 WHEN lft >= of_block THEN 1 WHEN used < lft THEN 1 ELSE 0 END AS uses FROM j)
SELECT doc_id, substr(skey, 2) AS source, n_tokens, epoch::INTEGER AS epoch, block,
       md5('mix|' || epoch || '|' || key) AS place
FROM u, unnest(range(0, uses)) AS e(epoch)
"""
