"""Calls to providers within a quota for each document: figures and unruled tables, and contexts of chunks.

A document's candidates go in order until ``cap`` of them have content, or until
the first that no model answers, after which that document is left alone. Rounds
ask for as many as each document still lacks; in a round equal keys, also of
different documents, are asked once, and what the cache has is not asked at all.
Replies are cached whether or not their document still had use for them: those
asked in the same round as a failure before them are only that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.stores import KeyedStore
from .chunks import context_keys
from .layout import borderless_table
from .prompts import Prompts
from .search_index import kept

#: Figures and tables of a document that are read, and the least sides of one.
CAP, LEAST = 40, (30, 20)
DONE = "doc_id, n, content"


def within_quota(candidates: DataFrame, ask: Callable[[str], Column], cache: KeyedStore, cap: int | None = CAP) -> DataFrame:
    """(doc_id, n, content) of the candidates that got content.

    candidates: doc_id, n (places within a document, in order, each once), key,
    prompt. ``ask``: a column of replies to the column that it is named, null where
    no model answers; an empty reply is no failure, and no content. ``cap`` null:
    all. Null keys are not cached and are asked each for itself.
    """
    own = kept(candidates.select("doc_id", "n", F.coalesce("key", F.concat_ws(":", F.lit("none"), "doc_id", "n")).alias("key"), "prompt", F.col("key").isNotNull().alias("_cached")))
    state = kept(own.groupBy("doc_id").agg(F.max("n").alias("last")).select("doc_id", "last", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("done")))
    order, out = Window.partitionBy("doc_id").orderBy("n"), []
    while not state.isEmpty():
        todo = own.join(state, "doc_id").filter("n > at")
        if cap is not None:
            todo = todo.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap - F.col("done")).drop("_r")
        todo = kept(todo)
        once = todo.groupBy("key").agg(F.min("prompt").alias("prompt"), F.bool_or("_cached").alias("_cached"))
        have, miss = cache.split(once)
        told = kept(miss.withColumn("value", ask("prompt")))
        new = told.filter("_cached and value is not null").select("key", "value")
        if not new.isEmpty():
            cache.put(new)
        known = have.select("key", "value").union(told.filter("value is not null").select("key", "value"))
        got = todo.join(known, "key", "left").withColumn("_stop", F.min(F.when(F.col("value").isNull(), F.col("n"))).over(Window.partitionBy("doc_id")))
        got = kept(got.select("doc_id", "n", "last", "done", "value", "_stop"))
        used = got.filter("(_stop is null or n < _stop) and value <> ''")
        out.append(used.select("doc_id", "n", F.col("value").alias("content")))
        after = got.groupBy("doc_id", "last", "done").agg(F.max("n").alias("at"), F.max("_stop").alias("_stop"), F.count_if(F.col("value") != "").alias("_more"))
        after = after.filter("_stop is null").withColumn("done", F.col("done") + F.col("_more")).filter("at < last")
        after = after if cap is None else after.filter(F.col("done") < cap)
        state = kept(after.select("doc_id", "last", "at", "done"))
    return reduce(DataFrame.unionByName, out) if out else own.select("doc_id", "n", F.col("prompt").alias("content")).limit(0)


def enriched(blocks: DataFrame, router, cache: KeyedStore, crop: Column | None = None, cap: int = CAP, prompts: Prompts | None = None) -> DataFrame:
    """``blocks`` (doc_id, page, seq, type, content, box) with the content of empty figures and unruled tables as the vision model reads them; such tables become tables.

    ``crop``: what is cut from the page, as text (a data URL, say) that goes into
    the prompt and the key; by default document, page and box, and so no two are
    equal. Without a vision model blocks stay as they are.
    """
    need = F.when((F.col("type") == "figure") & (strip(F.coalesce("content", F.lit(""))) == ""), "figure").when((F.col("type") == "text") & borderless_table(F.col("content")), "table")
    numbered = blocks.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq")).cast("long")).withColumn("need", need)
    if router is None or not router.available("vision"):
        return numbered.drop("n", "need")
    numbered, prompts = kept(numbered), prompts or Prompts()
    crop = crop if crop is not None else F.concat_ws("|", "doc_id", "page", "x0", "y0", "x1", "y1")
    wide = (F.col("x1") - F.col("x0") >= LEAST[0]) & (F.col("y1") - F.col("y0") >= LEAST[1])
    asked = F.concat(F.when(F.col("need") == "table", prompts.text("read_table")).otherwise(prompts.text("describe_figure")), F.lit("\n"), crop)
    key = F.concat(F.lit("vlm1:"), F.left(F.sha2(crop, 256), F.lit(32)))
    wanted = numbered.filter(F.col("need").isNotNull() & wide).select("doc_id", "n", key.alias("key"), asked.alias("prompt"))
    read = within_quota(wanted, lambda c: router.column("vision", c), cache, cap).withColumnRenamed("content", "_read")
    out = numbered.join(read, ["doc_id", "n"], "left")
    out = out.withColumn("type", F.when((F.col("need") == "table") & F.col("_read").isNotNull(), "table").otherwise(F.col("type"))).withColumn("content", F.coalesce("_read", "content"))
    return out.select(blocks.columns)


def with_contexts(made: DataFrame, labels: DataFrame, router, cache: KeyedStore, prompts: Prompts | None = None) -> DataFrame:
    """Chunks with ``context``, a sentence or two by the fast model on where each stands; null for short prose, after a failure in their document, and without a model."""
    if router is None or not router.available("fast"):
        return made.withColumn("context", F.lit(None).cast("string"))
    prompts = prompts or Prompts()
    keys = context_keys(made, labels)
    own = made.join(keys, "chunk_id").join(labels, "doc_id", "left")
    text = prompts.text("chunk_context", label=F.coalesce("label", F.lit("an unknown document")), heading=F.coalesce("heading", F.lit("")), excerpt=F.col("excerpt"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "section_id", "block_id", "chunk_id")).cast("long")
    wanted = kept(own.select("doc_id", "chunk_id", place.alias("n"), F.col("cache_key").alias("key"), text.alias("prompt")))
    told = within_quota(wanted, lambda c: router.column("fast", c), cache, None)
    return made.join(told.join(wanted.select("doc_id", "n", "chunk_id"), ["doc_id", "n"]).select("chunk_id", F.col("content").alias("context")), "chunk_id", "left")
