"""Briefs of a document and comparisons of two: checklists asked through the whole answering loop, and their Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import verify
from .answer import ABSTAIN, BRIEF, answer
from .retrieve import Retriever

#: The questions that two documents are compared by, and how an abstaining answer begins.
COMPARED = (
    ("Revenue", "What were total revenues for the period, in millions?"),
    ("Gross margin", "What was the GAAP gross margin, as a percentage?"),
    ("Net income", "What was GAAP net income or net loss for the period, in millions? Give the dollar amount, not the per-share figure."),
    ("EPS", "What was GAAP earnings or loss per diluted share, in dollars per share?"),
    ("Cash", "What was the total of cash, cash equivalents and short-term investments at period end, in millions?"),
)
ABSTAIN_MARK = ABSTAIN[:14]


def checklist(spark: SparkSession, items: Iterable[tuple[str, str]] = BRIEF) -> DataFrame:
    return spark.createDataFrame([(i, h, q) for i, (h, q) in enumerate(items)], "qid long, heading string, question string")


def sections(answered: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, heading, question, status, answer, claims, computed, verified, task) of a brief's items from their answers."""
    own = items.select("qid", F.col("heading"), "question").join(answered, "qid", "left")
    none = F.coalesce("answer", F.lit(ABSTAIN)).startswith(ABSTAIN_MARK)
    return own.select(
        "qid", "heading", "question", F.when(none, "not_disclosed").otherwise("answered").alias("status"), F.when(none, "").otherwise(F.col("answer")).alias("answer"), F.when(~none, F.col("claims")).alias("claims"),
        F.col("computed").isNotNull().alias("computed"), F.coalesce("verified", F.lit(True)).alias("verified"), "task",
    )


def run_brief(retriever: Retriever, doc_ids: list | None = None, router=None) -> DataFrame:
    """The sections of a brief: every item of the checklist through the whole loop, all in one pass."""
    items = checklist(SparkSession.active())
    return sections(answer(items.select("qid", "question"), retriever=retriever, router=router, doc_ids=doc_ids), items)


def run_briefs(documents: DataFrame, retriever: Retriever, items: Iterable[tuple[str, str]] = BRIEF, router=None) -> DataFrame:
    """The sections of a brief of each of any number of ``documents`` (doc_id): doc_id and the columns of :func:`sections`.

    Every item of the checklist is a question of its own for every document,
    asked of that document alone; all go through the loop together. A document
    without passages has every item not disclosed. Repeated and null doc_ids
    count once and not at all.
    """
    listed = checklist(documents.sparkSession, items).withColumnRenamed("qid", "item")  # a few rows
    docs = documents.filter("doc_id is not null").select("doc_id").distinct()
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("item"), F.lit(h).alias("heading"), F.lit(q).alias("question")) for i, h, q in sorted(map(tuple, listed.collect()))])
    asked = docs.select("doc_id", F.inline(rows)).withColumn("qid", F.concat_ws(":", "doc_id", "item"))
    found = answer(asked.select("qid", "question"), retriever=retriever, router=router, scope=asked.select("qid", "doc_id"))
    return sections(found, asked).join(asked.select("qid", "doc_id", "item"), "qid").drop("qid").withColumnRenamed("item", "qid")


def cite_marks(claims: list | None) -> str:
    """The places that claims cite, each once, in their order."""
    places = dict.fromkeys((c["page"], c["block_id"]) for claim in claims or () for c in claim["citations"] or ())
    return " ".join(f"[p{p}]" if b is None else f"[p{p}·b{b}]" for p, b in places)


def brief_markdown(found: DataFrame, label: str = "") -> str:
    """A page of a brief's sections; a checklist is a few rows."""
    rows = found.orderBy("qid").collect()
    answered = [r for r in rows if r.status == "answered"]
    out = [f"# Analyst brief — {label or 'Financial document'}\n"]
    for r in rows:
        text = "_Not disclosed in this document._"
        if r.status == "answered":
            text = f"{r.answer}{' *(computed)*' if r.computed else ''} {cite_marks(r.claims)}{'' if r.verified else '  ⚠ contains an unverified figure'}".rstrip()
        out.append(f"**{r.heading}.**\n{text}\n")
    state = "all figures verified against their citations" if all(r.verified for r in answered) else "see ⚠ flags"
    return "\n".join([*out, "---", f"_{len(answered)} of {len(rows)} items answered from the document; {state}._"])


def figures_of(answered: DataFrame, evidence: DataFrame) -> DataFrame:
    """The verified figure of each answer (qid, claims), as :func:`verify.verified_figures` finds it."""
    claims = answered.select("qid", F.posexplode("claims").alias("claim", "c")).select("qid", "claim", F.col("c.text").alias("text"), F.col("c.citations").alias("citations"))
    cited = claims.select("qid", "claim", F.posexplode("citations").alias("cite", "x")).select("qid", "claim", "cite", "x.page", "x.block_id")
    return verify.verified_figures(claims.select("qid", "claim", "text"), cited, evidence)


def compare_rows(a: DataFrame, b: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, heading, a, b, status, abs, pct, direction) from the verified figures (qid, value, raw, unit, page, block_id) of both sides; an item that neither has is not disclosed."""
    side = lambda t: items.select("qid", "heading").join(t.select("qid", "value", "unit"), "qid", "left")
    told = verify.compare(side(a), side(b))
    shown = lambda t, name: t.select("qid", F.struct("value", "raw", "unit", "page", "block_id").alias(name))
    return items.select("qid", "heading").join(shown(a, "a"), "qid", "left").join(shown(b, "b"), "qid", "left").join(told, "heading")


def run_compare(one: Retriever, other: Retriever, router=None) -> DataFrame:
    """The rows of a comparison: each item asked of both sides; a figure counts as far as the evidence of its own answer shows it."""
    items = checklist(SparkSession.active(), COMPARED)
    asked = items.select("qid", "question")
    side = lambda r: figures_of(*answer(asked, retriever=r, router=router, with_evidence=True))
    return compare_rows(side(one), side(other), items)


def compare_markdown(rows: DataFrame, label_a: str, label_b: str) -> str:
    """The change table of a comparison."""
    found = rows.orderBy("qid").collect()
    place = lambda f: "—" if f is None else f"{f.raw} [p{f.page}{'' if f.block_id is None else f'·b{f.block_id}'}]"

    def line(r) -> str:
        if r.status == "not_disclosed":
            return f"| {r.heading} | — | — | _not disclosed_ |"
        change = "_not compared — the two filings state this in different units_" if r.status == "unit_mismatch" else "—"
        if r.status == "compared":
            change = f"{r.abs:+,.4g}" + ("" if r.pct is None else f" ({r.pct:+.1f}%)")
        return f"| {r.heading} | {place(r.a)} | {place(r.b)} | {change} |"

    compared = sum(r.status == "compared" for r in found)
    head = [f"# {label_a} vs {label_b}", "", f"| Metric | {label_a} | {label_b} | Change |", "|---|---|---|---|"]
    return "\n".join([*head, *map(line, found), "", f"_{compared} of {len(found)} metrics compared, each figure cited to its block and verified against it._"])


def events(answered: DataFrame) -> DataFrame:
    """(qid, seq, step, detail): what happened to each question, in order, from the columns of its answer."""
    steps = F.array(
        F.struct(F.lit("supervise").alias("step"), F.col("task").alias("detail")), F.struct(F.lit("retrieve").alias("step"), F.concat(F.lit("attempts="), "attempts").alias("detail")),
        F.struct(F.lit("grade").alias("step"), F.col("grade").alias("detail")), F.struct(F.lit("generate").alias("step"), F.concat(F.lit("claims="), F.coalesce(F.size("claims"), F.lit(0))).alias("detail")),
        F.struct(F.lit("cite_check").alias("step"), F.when(F.col("verified"), "verified").otherwise(F.array_join("unverified", ", ")).alias("detail")),
    )
    return answered.select("qid", F.posexplode(steps).alias("seq", "e")).select("qid", "seq", "e.step", "e.detail")
