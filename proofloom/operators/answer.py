"""The keyless answering steps over a table of questions: lanes, context, grades, rewrites, extracts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import injections, intent, keywords, once, question_verdict, strip, wants_math
from ..streaming.ingest import shared_dir
from . import verify
from .calculator import evaluate, extracted
from .prompts import Prompts
from .retrieve import LocalRetriever, Retriever

#: What an answer without evidence says, how extracts begin, what an unsupported figure adds, and how often a question is asked.
ABSTAIN = "I couldn't find information to answer that in this document."
EXTRACTIVE = "Based on the document (extractive — set a cloud key for synthesized answers):\n\n"
CAVEAT = ("\n\nNote — unverified figure(s) not traceable to the cited evidence: ", " — treat with caution.")
MAX_ATTEMPTS, SOURCES = 3, 3
#: The questions of a first reading, and of a comparison of two documents.
BRIEF = (
    ("Revenue", "What were total revenues for the period?"),
    ("Revenue growth", "By how much did revenue change versus the prior year, in percent?"),
    ("Profitability", "What was operating profit, operating income, or income from operations?"),
    ("Margin", "What was the gross margin or operating margin?"),
    ("Bottom line", "What was net income or profit after tax, and earnings per diluted share?"),
    ("Cash", "What were cash, cash equivalents and short-term investments at period end, or cash generated from operations?"),
    ("Outlook", "What does management expect for the coming period — any guidance, outlook, or expected growth rate?"),
)


def lane(question: Column | str, many_documents: bool = False) -> Column:
    math = wants_math(question) | (intent(question) == "comparison")
    return F.when(math, "compare" if many_documents else "calc").otherwise("qa")


def history(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """``turns`` (q, a) with ``conversation``: the four turns before, answers cut to 200 characters; empty on the first."""
    line = F.concat(F.lit("User: "), "q", F.lit("\nAssistant: "), F.left("a", F.lit(200)))
    before = Window.partitionBy(by).orderBy(order).rowsBetween(-4, -1)
    return turns.withColumn("conversation", F.array_join(F.collect_list(line).over(before), "\n"))


def context(evidence: DataFrame, max_chars: int = 4500, per_entry: int = 1400) -> DataFrame:
    """(qid, context): the passages with their places and sections, as many as fit; the first always does.

    One entry for a section of a document, or for a block outside sections.
    The first entry that does not fit ends the context.
    """
    key = F.when(F.col("section_id").isNotNull(), F.to_json(F.struct("doc_id", "section_id"))).otherwise(F.to_json(F.struct("doc_id", "block_id", "page", F.lit("c").alias("kind"))))
    first = F.row_number().over(Window.partitionBy("qid", "_key").orderBy("pos")) == 1
    own = evidence.withColumn("_key", key).withColumn("_first", first).filter("_first")
    content, parent = strip(F.coalesce("content", F.lit(""))), strip(F.coalesce("parent_text", F.lit("")))
    cut = lambda c: F.left(c, F.lit(per_entry))
    apart = (content != "") & (parent != "") & ~F.contains(parent, content)
    body = F.when(apart, F.concat(cut(parent), F.lit("\n…\n"), cut(content))).otherwise(cut(F.when(parent != "", parent).otherwise(content)))
    head = F.coalesce(F.nullif("section_heading", F.lit("")), "heading", F.lit(""))
    entry = F.concat(F.lit("[page "), "page", F.lit(" | block "), F.coalesce(F.col("block_id").cast("string"), F.lit("None")), F.lit("] "), head, F.lit("\n"), body)
    own = own.withColumn("_entry", entry)
    order = Window.partitionBy("qid").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_fits", ((F.row_number().over(order) == 1) | (F.sum(F.length("_entry")).over(upto) <= max_chars)).cast("int"))
    own = own.withColumn("_keep", F.min("_fits").over(upto)).filter("_keep = 1")
    return own.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_entry"))), lambda x: x["_entry"]), "\n\n").alias("context"))


def grade(question: Column | str, text: Column | str, task: Column | str, bodies: Column | None = None) -> Column:
    """``relevant`` or ``weak``. For figures, whether ``bodies`` has a digit (default: the context with its tags, which always do)."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    wanted = F.array_distinct(keywords(question, 2))
    hits = once(F.lower(text), lambda body: F.size(F.filter(wanted, lambda t: F.contains(body, t))))
    qa = F.when(text == "", "weak").when(F.size(wanted) == 0, "relevant").when(hits >= 0.5 * F.size(wanted), "relevant").otherwise("weak")
    calc = F.when((bodies if bodies is not None else text).rlike("[0-9]"), "relevant").otherwise("weak")
    return F.when(F.col(task).isin("calc", "compare") if isinstance(task, str) else task.isin("calc", "compare"), calc).otherwise(qa)


def rewrite(original: Column | str, current: Column | str) -> Column:
    """The question's keywords; without any, the question as it is."""
    return F.coalesce(F.nullif(F.array_join(keywords(original), " "), F.lit("")), F.col(current) if isinstance(current, str) else current)


def extracts(evidence: DataFrame) -> DataFrame:
    """(qid, answer, claims): the first two sections with text, each quoted and cited. Sections count without their document."""
    first = F.row_number().over(Window.partitionBy("qid", F.coalesce(F.col("section_id").cast("string"), F.lit("none"))).orderBy("pos")) == 1
    own = evidence.withColumn("_first", first).filter("_first").withColumn("_quote", strip(F.coalesce("content", F.lit("")))).filter("_quote <> ''")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).filter("_n <= 2")
    claim = F.struct("_n", F.left("_quote", F.lit(300)).alias("text"), "page", "block_id", F.coalesce(F.nullif("parent_text", F.lit("")), "_quote").alias("part"))
    out = own.groupBy("qid").agg(F.array_sort(F.collect_list(claim)).alias("_c"))
    answer = F.concat(F.lit(EXTRACTIVE), F.array_join(F.transform("_c", lambda c: F.concat(F.lit("- "), c["part"])), "\n\n"))
    claims = F.transform("_c", lambda c: F.struct(c["text"].alias("text"), F.array(F.struct(c["page"].alias("page"), c["block_id"].alias("block_id"))).alias("citations")))
    return out.select("qid", answer.alias("answer"), claims.alias("claims"))


def flags(evidence: DataFrame) -> DataFrame:
    """(qid, page, flag): passages that carry instructions."""
    found = evidence.select("qid", "page", "pos", F.posexplode(injections("content")).alias("i", "hit"))
    return found.select("qid", "page", F.concat(F.lit("p"), F.col("page"), F.lit(":"), "hit").alias("flag"))


def sources(evidence: DataFrame) -> DataFrame:
    """(qid, sources): the first three pieces of evidence as they are shown beside an answer."""
    snippet = F.left(F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(200))
    own = evidence.filter(F.col("pos") < SOURCES).select("qid", F.struct("pos", "page", F.coalesce(F.nullif("section_heading", F.lit("")), "heading").alias("heading"), "type", "block_id", "exact", snippet.alias("snippet")).alias("s"))
    return own.groupBy("qid").agg(F.array_sort(F.collect_list("s")).alias("sources"))


# --- replies of models

_CITATION = "array<struct<page:variant,block_id:variant>>"


def without_fences(reply: Column | str) -> Column:
    """A reply without the lines that fence code."""
    return F.regexp_replace(reply, r"(?m)^```[A-Za-z]*[ \t]*\n?|```[ \t]*$", "")


def parse_reply(reply: Column | str) -> Column:
    """struct(answer, claims, insufficient) of a structured reply: its outermost JSON object, fences and prose around it left out.

    Null if there is no object or its answer is no string. Claims without text
    and citations without a whole page number are dropped; a block id that is
    not a whole number is null.
    """
    text = without_fences(F.trim(reply))
    body = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_kind = lambda v, path, kind: F.schema_of_variant(F.variant_get(v, path, "variant")) == kind
    whole = lambda v, path: F.when(is_kind(v, path, "BIGINT"), get(v, path, "long"))
    claims = F.coalesce(get(body, "$.claims", "array<variant>"), F.array().cast("array<variant>"))
    cites = lambda c: F.filter(
        F.transform(F.coalesce(get(c, "$.citations", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.struct(whole(x, "$.page").alias("page"), whole(x, "$.block_id").alias("block_id"))),
        lambda x: x["page"].isNotNull(),
    )
    told = F.transform(F.filter(claims, lambda c: is_kind(c, "$.text", "STRING") & (F.trim(get(c, "$.text", "string")) != "")), lambda c: F.struct(F.trim(get(c, "$.text", "string")).alias("text"), cites(c).alias("citations")))
    flag = get(body, "$.insufficient", "string")
    insufficient = F.coalesce(~F.lower(flag).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False))
    return F.when(is_kind(body, "$.answer", "STRING"), F.struct(F.trim(get(body, "$.answer", "string")).alias("answer"), told.alias("claims"), insufficient.alias("insufficient")))


def cite_check(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answers`` (qid, answer, claims, has_sources, computed) checked: answer with a caveat, verified, unverified.

    Answers without sources, or empty ones, have nothing to check. Claims are
    checked against what they cite; an answer without claims as a whole against
    the contents of all its evidence. ``computed`` is a number or null.
    """
    own = answers.filter(F.col("has_sources") & (F.coalesce("answer", F.lit("")) != ""))
    claims = own.select("qid", "computed", F.posexplode("claims").alias("claim", "c")).select("qid", "claim", "computed", F.col("c.text").alias("text"), F.col("c.citations").alias("citations"))
    cited = claims.select("qid", "claim", F.posexplode("citations").alias("cite", "x")).select("qid", "claim", "cite", "x.page", "x.block_id")
    checked = verify.check(claims, cited, evidence, "computed")
    by_claims = checked.groupBy("qid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("claim", "unverified"))), lambda x: x["unverified"])).alias("bad"))
    prose = own.filter(F.coalesce(F.size("claims"), F.lit(0)) == 0).join(evidence.groupBy("qid").agg(F.array_join(F.collect_list("content"), " ").alias("shown")), "qid", "left")
    by_text = prose.select("qid", verify.unsupported("answer", "shown", F.col("computed").cast("double")).alias("bad"))
    found = answers.join(by_claims.union(by_text), "qid", "left").withColumn("unverified", F.array_distinct(F.coalesce("bad", F.array().cast("array<string>")))).drop("bad")
    note = F.concat(F.lit(CAVEAT[0]), F.array_join("unverified", ", "), F.lit(CAVEAT[1]))
    return found.withColumn("answer", F.when(F.size("unverified") > 0, F.concat("answer", note)).otherwise(F.col("answer"))).withColumn("verified", F.size("unverified") == 0)


def synthesized(shown: DataFrame, router, prompts: Prompts | None = None) -> DataFrame:
    """(qid, reply) of ``shown`` (qid, original, context, note) by the model of the role answer; asked once more where a reply does not parse."""
    prompts = prompts or Prompts()
    body = prompts.text("generate_answer", context=F.col("context"), note=F.coalesce("note", F.lit("")), question=F.col("original"))
    first = shown.select("qid", body.alias("body")).withColumn("reply", router.column(prompts.role("generate_answer"), "body"))
    return first.withColumn("second", prompts.ask(router, "generate_again", parse_reply("reply").isNull(), prompt=F.col("body"))).select("qid", F.coalesce("second", "reply").alias("reply"))


def computed(questions: DataFrame, router=None, prompts: Prompts | None = None) -> DataFrame:
    """(qid, expr, result) of the questions (qid, task, original, context) that ask for arithmetic and whose model names an expression that has a value."""
    own = questions.filter(F.col("task").isin("calc", "compare"))
    if router is None or not router.available("fast"):
        return own.select("qid", F.lit(None).cast("string").alias("expr"), F.lit(None).cast("double").alias("result")).limit(0)
    asked = own.withColumn("reply", (prompts or Prompts()).ask(router, "calculate_expression", context=F.col("context"), question=F.col("original")))
    found = asked.withColumn("expr", extracted("reply")).filter("expr is not null").withColumn("v", evaluate("expr"))
    return found.filter("v.error is null").select("qid", "expr", F.col("v.value").alias("result"))


def standalone(questions: DataFrame, router=None, prompts: Prompts | None = None) -> DataFrame:
    """``questions`` (qid, question, conversation) with each follow-up put as a question of its own by the fast model; as it is where nothing was said before, or nothing answers."""
    if router is None or not router.available("fast") or "conversation" not in questions.columns:
        return questions
    told = F.coalesce(F.trim("conversation"), F.lit("")) != ""
    reply = (prompts or Prompts()).ask(router, "contextualize", told, conversation=F.coalesce("conversation", F.lit("")), question=F.coalesce("question", F.lit("")))
    return questions.withColumn("_alone", reply).withColumn("question", F.coalesce(F.nullif(F.trim("_alone"), F.lit("")), "question")).drop("_alone")


def graded_by_model(shown: DataFrame, router=None, prompts: Prompts | None = None) -> Column:
    """The fast model's grade of plain questions with context; null for others, and where no model answers."""
    if router is None or not router.available("fast"):
        return F.lit(None).cast("string")
    plain = ~F.col("task").isin("calc", "compare") & F.col("context").isNotNull()
    verdict = (prompts or Prompts()).ask(router, "grade", plain, context=F.coalesce("context", F.lit("")), question=F.coalesce("original", F.lit("")))
    return F.when(F.contains(F.lower(verdict), F.lit("relevant")), "relevant").when(verdict.isNotNull(), "weak")


def rewritten(router=None, prompts: Prompts | None = None) -> Column:
    """Other words for ``original``: the fast model's, else its keywords."""
    plain = rewrite("original", "question")
    if router is None or not router.available("fast"):
        return plain
    return F.coalesce(F.nullif(F.trim((prompts or Prompts()).ask(router, "rewrite_query", question=F.coalesce("original", F.lit("")))), F.lit("")), plain)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows works on one result."""
    path = f"{shared_dir(df.sparkSession)}/proofloom/answer-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def answer(questions: DataFrame, passages: DataFrame | None = None, k: int = 6, strict: bool = True, retriever: Retriever | None = None, router=None, doc_ids: list | None = None, scope: DataFrame | None = None, with_evidence: bool = False, prompts: Prompts | None = None):
    """(qid, task, attempts, grade, answer, claims, sources, flags, computed, verified, unverified) of each question.

    Weak retrieval is tried again with the question's keywords; a third attempt
    would ask the same again, so it only counts. ``strict`` grades figures by
    the passages rather than by their tags. Without a model for the role
    ``answer`` of ``router`` (see providers), answers are extracts. Questions
    without evidence abstain: no claims, no sources. Each attempt's evidence is
    written once.
    """
    retriever = retriever or LocalRetriever(passages)
    prompts, keyed = prompts or Prompts(), router is not None and router.available("fast")
    posed = questions.withColumn("_verdict", question_verdict("question"))
    refused = posed.filter("_verdict <> 'ok'").select("qid", lane("question").alias("task"), F.lit(0).alias("attempts"), F.col("_verdict").alias("grade"))
    posed = standalone(posed.filter("_verdict = 'ok'"), router, prompts)
    asked = posed.select("qid", F.col("question").alias("original"), "question", lane("question").alias("task"))
    asked = _kept(asked) if keyed else asked
    done, evidence, contexts = [refused], [], []
    for attempt in (1, 2):
        found = _kept(located(retriever.retrieve(asked.select("qid", "question"), k, doc_ids, **({} if scope is None else {"scope": scope}))))
        shown = asked.join(context(found), "qid", "left").join(found.groupBy("qid").agg(F.array_join(F.collect_list("content"), " ").alias("bodies")), "qid", "left")
        plain = grade("original", "context", "task", F.coalesce("bodies", F.lit("")) if strict else None)
        graded = _kept(shown.withColumn("grade", F.coalesce(graded_by_model(shown, router, prompts), plain)))
        good = graded.filter("grade = 'relevant' and context is not null")
        done.append(good.select("qid", "task", F.lit(attempt).alias("attempts"), "grade"))
        contexts.append(good.select("qid", "task", "original", "context"))
        evidence.append(found.join(good.select("qid"), "qid", "left_semi"))
        weak = graded.join(good.select("qid"), "qid", "left_anti")
        asked = weak.select("qid", "original", rewritten(router, prompts).alias("question"), "task")
        asked = _kept(asked) if keyed else asked
    done.append(asked.select("qid", "task", F.lit(MAX_ATTEMPTS), F.lit("weak")))
    evidence, shown = reduce(DataFrame.unionByName, evidence), reduce(DataFrame.union, contexts)
    numbers = computed(shown, router, prompts)
    answers = extracts(evidence)
    if router is not None and router.available("answer"):
        answers = _by_model(shown, numbers, evidence, answers, router, prompts)
    out = reduce(DataFrame.union, done).join(answers, "qid", "left").join(numbers.select("qid", F.col("result").alias("computed")), "qid", "left").join(sources(evidence), "qid", "left")
    warned = flags(evidence).groupBy("qid").agg(F.sort_array(F.collect_set("flag")).alias("flags"))
    out = out.withColumn("answer", F.coalesce("answer", F.lit(ABSTAIN))).withColumn("has_sources", F.col("sources").isNotNull() & ~F.col("answer").startswith(ABSTAIN))
    out = cite_check(out.join(warned, "qid", "left"), evidence).drop("has_sources")
    return (out, evidence) if with_evidence else out


def located(found: DataFrame) -> DataFrame:
    """Evidence with all columns that answers need; what passages do not have is null."""
    kinds = {"page": "int", "block_id": "int", "section_id": "int", "doc_id": "long", "section_heading": "string", "heading": "string", "parent_text": "string", "type": "string"}
    return found.select(*found.columns, *[F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in found.columns])


def _by_model(shown: DataFrame, numbers: DataFrame, evidence: DataFrame, plain: DataFrame, router, prompts: Prompts | None = None) -> DataFrame:
    """(qid, answer, claims) by the model: cited claims validated and snapped; prose where a reply does not parse; extracts where no model answers."""
    note = F.concat(F.lit("\nA verified exact calculation: "), "expr", F.lit(" = "), F.col("result").cast("string"))
    told = _kept(synthesized(shown.join(numbers, "qid", "left").withColumn("note", note), router, prompts).withColumn("r", parse_reply("reply")))
    claims = told.filter("not r.insufficient").select("qid", F.posexplode("r.claims").alias("claim", "c")).select("qid", "claim", F.col("c.text").alias("text"), "c.citations")
    cited = claims.select("qid", "claim", "text", F.posexplode("citations").alias("cite", "x")).select("qid", "claim", "cite", F.col("x.page").cast("int").alias("page"), F.col("x.block_id").cast("int").alias("block_id"), "text")
    snapped = verify.snap(verify.validate(cited, evidence), evidence).groupBy("qid", "claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("cite", "page", "block_id"))), lambda x: F.struct(x["page"].alias("page"), x["block_id"].alias("block_id"))).alias("citations"))
    none = F.array().cast("array<struct<page:int,block_id:int>>")
    whole = claims.select("qid", "claim", "text").join(snapped, ["qid", "claim"], "left").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim", "text", F.coalesce("citations", none).alias("citations")))), lambda x: F.struct(x["text"].alias("text"), x["citations"].alias("citations"))).alias("claims"))
    text = F.when(F.col("r").isNull(), F.nullif(F.trim("reply"), F.lit(""))).when(F.col("r.insufficient"), ABSTAIN).otherwise(F.col("r.answer"))
    told = told.filter("reply is not null").select("qid", F.coalesce(text, F.lit(ABSTAIN)).alias("answer")).join(whole, "qid", "left")
    return told.unionByName(plain.join(told, "qid", "left_anti"))
