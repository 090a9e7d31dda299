"""Registered queries over documents, pages, stores, replies and reports, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answer, brief, enrich, evals, layout, pages, retrieve, search_index, verify
from ..sources import blocks as S
from ..sources import pdf, stores
from ..streaming.ingest import shared_dir
from .catalog import _HAS, _top, query
from .inputs import CLAIMS, EVIDENCE, claims, evidence, t

# --- pages of documents ------------------------------------------------------------------------------------------

#: A document for each customer, a page for each order; characters by the price.
_PAGED = "paged AS (SELECT o_custkey AS doc_id, o_orderkey::INT AS page, (o_totalprice % 170)::INT AS chars FROM orders)"


def _paged(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page"), F.bround(F.col("o_totalprice") % 170).cast("int").alias("chars"))


_ROUTED = _PAGED.replace("(o_totalprice % 170)::INT", "round_even(o_totalprice % 170, 0)::INT") + ", routed AS (SELECT *, CASE WHEN chars > 50 THEN 'textlayer' ELSE 'ocr' END AS parser FROM paged)"


@query(f"WITH {_ROUTED} SELECT doc_id, CASE WHEN count(DISTINCT parser) = 1 THEN min(parser) ELSE 'mixed' END AS parser FROM routed GROUP BY 1")
def document_parsers(spark, sf_dir):
    return pages.document_parsers(pages.parsers(_paged(spark, sf_dir)))


@query(f"WITH {_ROUTED}, a AS (SELECT doc_id, bool_and(parser = 'ocr') AS scanned, string_agg(page::VARCHAR, ' ' ORDER BY page) FILTER (parser = 'ocr') AS p FROM routed GROUP BY 1) SELECT doc_id, scanned, CASE WHEN NOT scanned THEN coalesce(p, '') END AS skipped_pages FROM a")
def skipped_pages(spark, sf_dir):
    out = pages.skipped(pages.parsers(_paged(spark, sf_dir)))
    return out.select("doc_id", "scanned", F.array_join(F.transform("skipped_pages", lambda x: x.cast("string")), " ").alias("skipped_pages"))


@query(
    f"""WITH {_ROUTED}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i FROM routed),
k AS (SELECT unnest(range(0, 14)) AS k), s AS (SELECT DISTINCT n.doc_id, n.page, n.chars FROM n, k WHERE n <= 14 OR i = round_even(k * (n - 1) / 13.0, 0))
SELECT doc_id, max(chars) > 150 OR sum(chars) > 600 AS has_text FROM s GROUP BY 1"""
)
def text_layer_sample(spark, sf_dir):
    return pages.text_layer(_paged(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D\\x20]+', '', 'g')) AS text_sha256, false AS failed FROM documents")
def pdf_round_trip(spark, sf_dir):
    """Every document written as a PDF file and read back page by page: the hash of its characters that are not white space."""
    rows = pdf.from_files(pdf.render(t(spark, sf_dir, "documents")))
    runs = F.array_sort(F.collect_list(F.when(F.col("kind") == "span", F.struct("page", "seq", "text"))))
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(runs, lambda r: r["text"]), "").alias("text"), F.bool_or(F.col("kind") == "error").alias("failed"))
    return whole.select("doc_id", F.sha2(F.regexp_replace("text", r"[\x09-\x0D\x20]+", ""), 256).alias("text_sha256"), "failed")


_STROKES = "strokes AS (SELECT l_suppkey AS doc_id, l_orderkey % 8 AS page, CASE l_returnflag WHEN 'A' THEN 'l' WHEN 'R' THEN 're' ELSE 'c' END AS op FROM lineitem)"


@query(f"WITH {_STROKES} SELECT doc_id, page FROM strokes GROUP BY 1, 2 HAVING sum(CASE op WHEN 'l' THEN 1 WHEN 're' THEN 4 ELSE 0 END) >= 6")
def table_gate(spark, sf_dir):
    op = F.when(F.col("l_returnflag") == "A", "l").when(F.col("l_returnflag") == "R", "re").otherwise("c")
    return pages.may_have_tables(t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 8).alias("page"), op.alias("op")))


@query("SELECT p_partkey, (p_size & 16) <> 0 OR regexp_matches(lower(p_type || CASE WHEN p_partkey % 9 = 0 THEN '-SemiBold' ELSE '' END), 'bold|black|heavy') AS bold FROM part")
def bold_fonts(spark, sf_dir):
    font = F.concat("p_type", F.when(F.col("p_partkey") % 9 == 0, "-SemiBold").otherwise(""))
    return t(spark, sf_dir, "part").select("p_partkey", pages.bold(font, F.col("p_size").cast("int")).alias("bold"))


_SPANS = """spans AS (SELECT l_orderkey AS page, l_linenumber AS seq, (l_quantity / 5)::DOUBLE AS size, l_returnflag = 'R' AS bold, l_extendedprice % 842 AS y1,
  CASE WHEN l_linenumber % 3 = 0 THEN repeat('long words ', 10) WHEN l_linenumber % 5 = 0 THEN 'Ends here.' ELSE 'Heading ' || l_partkey END AS content FROM lineitem),
bodies AS (SELECT page, avg(size) AS body FROM spans GROUP BY 1),
typed AS (SELECT s.*, CASE WHEN y1 >= 0.94 * 842 AND length(trim(content)) < 80 THEN 'footer' WHEN length(trim(content)) > 90 OR regexp_matches(trim(content), '[.,;:]$') THEN 'text' WHEN size >= 1.2 * body OR (bold AND size >= 1.12 * body) THEN 'title' ELSE 'text' END AS type FROM spans s JOIN bodies USING (page))"""


def _places(spark, sf_dir):
    """The line items, with the place where each stands in the table's files."""
    return t(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))


def _in_place(by):
    """All rows of a key in the order of the files: a sum of doubles depends on its order in the last bit, and must not on tasks."""
    return Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _typed(spark, sf_dir):
    n = F.col("l_linenumber")
    content = F.when(n % 3 == 0, F.repeat(F.lit("long words "), 10)).when(n % 5 == 0, "Ends here.").otherwise(F.concat(F.lit("Heading "), "l_partkey"))
    s = _places(spark, sf_dir).select("place", F.col("l_orderkey").alias("page"), n.alias("seq"), (F.col("l_quantity") / 5).cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_extendedprice") % 842).alias("y1"), content.alias("content"))
    s = s.withColumn("body", F.avg("size").over(_in_place("page"))).drop("place")
    return s.withColumn("type", layout.block_type(F.col("content"), F.col("size"), F.col("body"), F.col("bold"), F.col("y1"), F.lit(842.0)))


@query(f"WITH {_SPANS} SELECT page, seq, type FROM typed")
def block_types(spark, sf_dir):
    return _typed(spark, sf_dir).select("page", "seq", "type")


@query(
    f"""WITH {_SPANS}, x AS (SELECT (page % 50) AS page, page AS doc, seq, size, type FROM typed),
w AS (SELECT *, count(*) FILTER (type = 'title') OVER (PARTITION BY page) AS n, max(CASE WHEN type = 'title' THEN size END) OVER (PARTITION BY page) AS top FROM x)
SELECT doc, seq, CASE WHEN type = 'title' AND n > 4 AND size < 0.92 * top THEN 'text' ELSE type END AS type FROM w"""
)
def demoted_titles(spark, sf_dir):
    b = _typed(spark, sf_dir).withColumn("doc", F.col("page")).withColumn("page", F.col("page") % 50)
    return layout.demote_titles(b, ["page"]).select("doc", "seq", "type")


@query(
    """WITH c AS (SELECT l_orderkey, list([l_partkey::VARCHAR, CASE WHEN l_linenumber % 2 = 0 THEN l_comment ELSE '(' || l_quantity::INT || ')' END]) AS cells, sum(l_discount) AS area FROM (SELECT *, l_returnflag || ' x' AS l_comment FROM lineitem) GROUP BY 1),
f AS (SELECT *, flatten(cells) AS fl FROM c)
SELECT l_orderkey, len(cells) >= 2 AND area <= 0.85 AND len(list_filter(fl, lambda x: regexp_full_match(x, '[-(]?[0-9][0-9,.]*\\)?%?'))) / len(fl) >= 0.15 AS accepted FROM f"""
)
def accepted_tables(spark, sf_dir):
    cell = F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.lit(" x"))).otherwise(F.concat(F.lit("("), F.col("l_quantity").cast("int"), F.lit(")")))
    summed = _places(spark, sf_dir).withColumn("area", F.sum("l_discount").over(_in_place("l_orderkey")))
    c = summed.groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_partkey").cast("string"), cell)).alias("cells"), F.max("area").alias("area"))
    return c.select("l_orderkey", layout.table_accepted(F.col("cells"), F.col("area")).alias("accepted"))


# --- stores ------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS doc_hash, string_agg(DISTINCT month(o_orderdate)::VARCHAR, ' ' ORDER BY month(o_orderdate)::VARCHAR) AS pages FROM orders GROUP BY 1")
def cached_pages(spark, sf_dir):
    c = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_hash"), F.month("o_orderdate").alias("page"), F.lit("textlayer").alias("parser"))
    return stores.cached_pages(c).select("doc_hash", F.array_join(F.sort_array(F.transform("pages", lambda p: p.cast("string"))), " ").alias("pages"))


def _texts(spark, sf_dir):
    """A text cache with two batches: all parts, then every third anew."""
    store = stores.text_cache(spark, f"{shared_dir(spark)}/proofloom/texts-{uuid.uuid4().hex[:12]}")
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ctx"), F.col("p_partkey") % 4, F.lit("_"), "p_partkey").alias("key"), F.col("p_name").alias("value"))
    store.put(p.select("key", "value"))
    store.put(p.filter("p_partkey % 3 = 0").select("key", F.upper("value").alias("value")))
    return store


@query("SELECT 'ctx' || p_partkey % 4 || '_' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS value FROM part WHERE p_partkey % 4 = 2")
def text_cache_scan(spark, sf_dir):
    return _texts(spark, sf_dir).scan("ctx2_")


@query("SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS text FROM orders WHERE o_custkey % 5 <> 0 OR o_orderkey % 2 = 0 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def index_upsert(spark, sf_dir):
    """Documents of every fifth customer are indexed anew, with half of their chunks, twice over."""
    index = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("text"))
    new = index.filter("doc_id % 5 = 0 and chunk_id % 2 = 0").withColumn("text", F.lit("new"))
    return stores.upsert_index(index, new.union(new))


@query("SELECT o_orderpriority AS name, max(o_orderkey) AS version, 'Dear ' || arg_max(o_custkey, o_orderkey) || ': $5 for ' || arg_max(o_custkey, o_orderkey) || '.' AS text FROM orders GROUP BY 1")
def latest_prompts(spark, sf_dir):
    """The latest version of each prompt, rendered."""
    p = stores.prompt(t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("version"), "o_custkey"))
    return p.select("name", "version", stores.render("Dear $who: $$5 for ${who}.", {"who": F.col("o_custkey")}).alias("text"))


@query(
    """WITH e AS (SELECT CASE p_partkey % 5 WHEN 4 THEN 'broken' ELSE left(p_name, 5) || CASE p_partkey % 5 WHEN 3 THEN '_multipage_1-2.png-' ELSE '_' || p_partkey || '.png-' END || p_partkey END AS qid, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS query, left(p_name, 5) AS stem, p_partkey, p_brand, p_size FROM part),
l AS (SELECT DISTINCT left(p_name, 5) AS stem FROM part WHERE p_size % 3 <> 0)
SELECT qid, query AS question, p_brand AS category, stem || '.pdf' AS doc_name, p_size || ' ' || p_partkey AS pages FROM e WHERE p_partkey % 5 <> 4 AND query IS NOT NULL AND stem IN (SELECT stem FROM l)"""
)
def benchmark_cases(spark, sf_dir):
    p, k = t(spark, sf_dir, "part"), F.col("p_partkey")
    middle = F.when(k % 5 == 3, F.lit("_multipage_1-2.png-")).otherwise(F.concat(F.lit("_"), k, F.lit(".png-")))
    stem = F.left("p_name", F.lit(5))
    entries = p.select(F.when(k % 5 == 4, "broken").otherwise(F.concat(stem, middle, k)).alias("qid"), F.when(k % 7 != 0, F.col("p_type")).alias("query"), F.lit(None).cast("string").alias("answer"), F.col("p_brand").alias("category"), F.lit(None).cast("string").alias("answer_type"), F.concat("p_size", F.lit(", "), k).alias("from_pages"))
    listing = p.filter("p_size % 3 <> 0").select(F.concat(stem, F.lit(".pdf")).alias("name"))
    return stores.load_cases(entries, listing).select("qid", "question", "category", "doc_name", F.array_join(F.transform("gold_pages", lambda x: x.cast("string")), " ").alias("pages"))


@query("SELECT p_partkey, nullif(regexp_extract(p_name || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'multipage_3-4' ELSE p_size::VARCHAR END || CASE WHEN p_partkey % 3 = 0 THEN '.jpg-1' ELSE '.png-1' END, '^(.+?)_(?:multipage_[0-9]+(?:-[0-9]+)*|[0-9]+)\\.png-[0-9]+$', 1), '') AS stem FROM part")
def stems_by_pattern(spark, sf_dir):
    qid = F.concat("p_name", F.lit("_"), F.when(F.col("p_partkey") % 2 == 0, "multipage_3-4").otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 3 == 0, ".jpg-1").otherwise(".png-1"))
    return t(spark, sf_dir, "part").select("p_partkey", stores.stem_of(qid).alias("stem"))


@query("SELECT count(*) FILTER (o_orderkey % 9 <> 0) AS docs, sum(o_custkey) FILTER (o_orderkey % 9 <> 0) AS pages, sum(o_custkey * 2) FILTER (o_orderkey % 9 <> 0) AS chunks, 0::BIGINT AS enriched, count(*) FILTER (o_orderkey % 9 <> 0 AND o_orderkey % 2 = 0) AS skipped_pages, count(*) FILTER (o_orderkey % 9 = 0) AS failed FROM orders")
def corpus_totals(spark, sf_dir):
    k = F.col("o_orderkey")
    r = t(spark, sf_dir, "orders").select(k.cast("string").alias("doc_name"), F.col("o_custkey").alias("pages"), (F.col("o_custkey") * 2).alias("chunks"), F.lit(0).alias("enriched"), F.when(k % 2 == 0, F.array(F.lit(1))).alias("skipped_pages"), F.when(k % 9 == 0, "scanned").alias("error"))
    return stores.corpus_totals(r).select("docs", "pages", "chunks", "enriched", "skipped_pages", F.size("failed_docs").cast("long").alias("failed"))


@query("SELECT s_suppkey, array_to_string(list_filter(list_transform(string_split('a' || s_suppkey || ' , ,b' || CASE WHEN s_suppkey % 2 = 0 THEN ',' ELSE '' END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS models FROM supplier")
def model_chains(spark, sf_dir):
    c = F.concat(F.lit("a"), "s_suppkey", F.lit(" , ,b"), F.when(F.col("s_suppkey") % 2 == 0, ",").otherwise(""))
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(stores.chain(c), "|").alias("models"))


# --- retrieval in a scope ----------------------------------------------------------------------------------------

_SCOPED = """postings AS (SELECT doc_id AS chunk_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z0-9$%.]+')) AS term FROM documents) GROUP BY ALL),
weights AS (SELECT term, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings GROUP BY term),
aterms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9$%.]+')) AS term FROM benchmark) GROUP BY ALL),
one AS (SELECT min(source) AS source FROM documents),
scores AS (SELECT qid, chunk_id, round(sum(qtf * tf * idf), 6) AS score FROM aterms JOIN weights USING (term) JOIN postings USING (term) WHERE source = (SELECT source FROM one) GROUP BY ALL)"""


@query(f"WITH {_SCOPED}, {_top('sparse', 'scores', 30)} SELECT qid, chunk_id, score, rank FROM sparse")
def scoped_topk(spark, sf_dir):
    """The 30 best passages of one document (here: a source) for each question, with the weights of the whole corpus."""
    d = t(spark, sf_dir, "documents")
    one = d.agg(F.min("source")).first()[0]
    index = retrieve.temporary_index(d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text")).scoped([one])
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return index.search(q)


_SCOPE = "scope AS (SELECT item_id AS qid, source FROM benchmark, (SELECT DISTINCT source FROM documents) WHERE (item_id + ascii(right(source, 1))) % 3 = 0)"
_SCOPED_EACH = _SCOPED.replace("one AS (SELECT min(source) AS source FROM documents)", _SCOPE).replace("WHERE source = (SELECT source FROM one)", "SEMI JOIN scope USING (qid, source)")


@query(f"WITH {_SCOPED_EACH}, {_top('sparse', 'scores', 10)} SELECT qid, chunk_id, score, rank FROM sparse")
def scope_table_topk(spark, sf_dir):
    """The 10 best passages for each question among the documents (here: sources) that it is asked of, all in one plan."""
    d, b = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    third = F.explode(F.array(*[F.lit(k) for k in range(3)]))
    sources = d.select(F.col("source").alias("doc_id")).distinct().withColumn("k", F.pmod(F.lit(3) - F.ascii(F.right("doc_id", F.lit(1))) % 3, F.lit(3)))
    scope = b.select(F.col("item_id").alias("qid"), third.alias("k")).filter(F.col("qid") % 3 == F.col("k")).join(sources, "k").select("qid", "doc_id")
    q = b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    index = search_index.Index.temporary(d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text"), asked=q)
    return index.search(q, 10, scope, prune=True)


_VERSIONED = """held AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'renewed ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9$%.]+')) AS term FROM held) GROUP BY ALL),
weights AS (SELECT term, ln(((SELECT count(*) FROM held) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings GROUP BY term),
aterms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower('renewed ' || text), '[a-z0-9$%.]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT qid, chunk_id, round(sum(qtf * tf * idf), 6) AS score FROM aterms JOIN weights USING (term) JOIN postings USING (term) GROUP BY ALL)"""


@query(f"WITH {_VERSIONED}, {_top('sparse', 'scores', 10)} SELECT qid, chunk_id, score, rank FROM sparse")
def index_versions(spark, sf_dir):
    """A search of an index of all documents, after every seventh was taken out and every fifth indexed anew."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    index = search_index.VersionedIndex(spark, search_index.scratch(spark, "versions"))
    index.upsert(d)
    index.delete(d.filter("doc_id % 7 = 0").select("doc_id"))
    index.upsert(d.filter("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("renewed "), F.coalesce("text", F.lit("")))))
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("renewed "), "text").alias("question"))
    return index.open().search(q, 10)


# --- replies, answers and reports --------------------------------------------------------------------------------

_REPLIES = """replies AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'It is ' || o_custkey WHEN 1 THEN '{"answer": ' || o_custkey || '}' ELSE
  CASE WHEN o_orderkey % 2 = 0 THEN '```json' || chr(10) ELSE 'Sure: ' END || '{"answer": " A' || o_custkey || ' ", "insufficient": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ', "claims": [{"text": "c' || o_orderkey || '", "citations": [{"page": ' || o_orderkey % 9 || ', "block_id": ' ||
  CASE WHEN o_orderkey % 4 = 0 THEN '"x"' ELSE (o_orderkey % 7)::VARCHAR END || '}, {"page": "no"}]}, {"text": " "}, {"note": 1}]}' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '```' ELSE ' Bye' END END AS reply FROM orders)"""


def _replies(spark, sf_dir):
    k = F.col("o_orderkey")
    even = k % 2 == 0
    body = F.concat(
        F.lit('{"answer": " A'), "o_custkey", F.lit(' ", "insufficient": '), F.when(k % 3 == 0, "true").otherwise("false"), F.lit(', "claims": [{"text": "c'), k, F.lit('", "citations": [{"page": '), k % 9, F.lit(', "block_id": '),
        F.when(k % 4 == 0, '"x"').otherwise((k % 7).cast("string")), F.lit('}, {"page": "no"}]}, {"text": " "}, {"note": 1}]}'),
    )
    whole = F.concat(F.when(even, "```json\n").otherwise("Sure: "), body, F.when(even, "\n```").otherwise(" Bye"))
    reply = F.when(k % 5 == 0, F.concat(F.lit("It is "), "o_custkey")).when(k % 5 == 1, F.concat(F.lit('{"answer": '), "o_custkey", F.lit("}"))).otherwise(whole)
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", reply.alias("reply"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN 'A' || o_custkey END AS answer, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 3 = 0 END AS insufficient,
CASE WHEN o_orderkey % 5 > 1 THEN 'c' || o_orderkey || '@' || o_orderkey % 9 || ':' || CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE (o_orderkey % 7)::VARCHAR END END AS claims FROM orders"""
)
def parse_replies(spark, sf_dir):
    r = _replies(spark, sf_dir).select("o_orderkey", answer.parse_reply("reply").alias("r"))
    cite = lambda c: F.transform(c["citations"], lambda x: F.concat(x["page"], F.lit(":"), F.coalesce(x["block_id"].cast("string"), F.lit("-"))))
    told = F.array_join(F.transform("r.claims", lambda c: F.concat(c["text"], F.lit("@"), F.array_join(cite(c), ","))), ";")
    return r.select("o_orderkey", "r.answer", "r.insufficient", told.alias("claims"))


@query(f"WITH {_REPLIES} SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 AND o_orderkey % 2 = 0 THEN replace(replace(reply, '```json' || chr(10), ''), '```', '') ELSE reply END AS text FROM replies")
def fences_stripped(spark, sf_dir):
    return _replies(spark, sf_dir).select("o_orderkey", answer.without_fences("reply").alias("text"))


@query(f"WITH {EVIDENCE} SELECT qid, string_agg(page || ':' || block_id || ' ' || section_heading || ' ' || content, ';' ORDER BY pos) AS sources FROM evidence WHERE pos < 3 GROUP BY 1")
def top_sources(spark, sf_dir):
    s = answer.sources(evidence(spark, sf_dir).withColumns({"type": F.lit("text"), "exact": F.lit(False)}))
    return s.select("qid", F.array_join(F.transform("sources", lambda x: F.concat(x["page"], F.lit(":"), x["block_id"], F.lit(" "), x["heading"], F.lit(" "), x["snippet"])), ";").alias("sources"))


_CHECKED = f"""shown AS (SELECT c.qid, c.claim, string_agg(replace(e.s, ',', ''), ' ') AS s FROM claims c JOIN (SELECT qid, page, block_id, arg_max(content || ' ' || parent_text, pos) AS s FROM evidence GROUP BY ALL) e ON c.qid = e.qid AND c.page = e.page AND (c.block_id = e.block_id OR c.block_id IS NULL) GROUP BY ALL),
nums AS (SELECT c.qid, c.claim, coalesce(s, '') AS s, list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\\\\.[0-9]+)?'), lambda x: replace(x, ',', '')) AS ns FROM claims c LEFT JOIN shown USING (qid, claim)),
bad AS (SELECT qid, claim, list_filter(ns, lambda n: NOT regexp_full_match(n, '(19|20)[0-9]{{{{2}}}}') AND NOT {_HAS.format(c="s", n="n")}) AS bad FROM nums),
per AS (SELECT qid, list_filter(fl, lambda x, i: list_position(fl, x) = i) AS bad FROM (SELECT qid, flatten(list(bad ORDER BY claim)) AS fl FROM bad GROUP BY 1))""".replace("{{{{2}}}}", "{{2}}").replace("{{2}}", "{2}").replace("\\\\.", "\\.")


@query(f"WITH {EVIDENCE}, {CLAIMS}, {_CHECKED} SELECT qid, CASE WHEN qid % 4 = 0 THEN 'None' WHEN len(bad) > 0 THEN 'It was so.' || chr(10) || chr(10) || 'Note — unverified figure(s) not traceable to the cited evidence: ' || array_to_string(bad, ', ') || ' — treat with caution.' ELSE 'It was so.' END AS answer, qid % 4 = 0 OR len(bad) = 0 AS verified FROM per")
def checked_answers(spark, sf_dir):
    """Each customer's answer with its claims checked; those without sources have nothing to check."""
    c = claims(spark, sf_dir)
    told = c.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim", "text", "page", "block_id"))), lambda x: F.struct(x["text"].alias("text"), F.array(F.struct(x["page"].alias("page"), x["block_id"].alias("block_id"))).alias("citations"))).alias("claims"))
    own = told.select("qid", F.when(F.col("qid") % 4 == 0, "None").otherwise("It was so.").alias("answer"), "claims", (F.col("qid") % 4 != 0).alias("has_sources"), F.lit(None).cast("double").alias("computed"))
    return answer.cite_check(own, evidence(spark, sf_dir)).select("qid", "answer", "verified")


@query(
    f"""WITH {EVIDENCE}, {CLAIMS}, s AS (SELECT qid % 7 AS i, 'Item ' || qid % 7 AS heading, count(*) FILTER (qid % 3 <> 0) AS answered, count(*) AS n FROM (SELECT DISTINCT qid FROM claims) GROUP BY ALL)
SELECT heading, n, answered, n - answered AS not_disclosed FROM s"""
)
def brief_status(spark, sf_dir):
    """How many of a checklist's items each have an answer, over all customers' answers."""
    q = claims(spark, sf_dir).select("qid").distinct()
    items = q.select("qid", F.concat(F.lit("Item "), F.col("qid") % 7).alias("heading"), F.lit("?").alias("question"))
    told = q.select("qid", F.when(F.col("qid") % 3 == 0, answer.ABSTAIN).otherwise("x").alias("answer"), F.array().cast("array<struct<text:string,citations:array<struct<page:int,block_id:int>>>>").alias("claims"), F.lit(None).cast("double").alias("computed"), F.lit(True).alias("verified"), F.lit("qa").alias("task"))
    s = brief.sections(told, items)
    return s.groupBy("heading").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "answered").alias("answered"), F.count_if(F.col("status") == "not_disclosed").alias("not_disclosed"))


@query(
    """WITH v AS (SELECT c_nationkey AS k, c_mktsegment AS seg, round(sum(c_acctbal), 2) AS value, CASE WHEN c_nationkey % 4 = 0 AND c_mktsegment = 'BUILDING' THEN 'percent' ELSE 'million' END AS unit FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT (c_nationkey % 5 = 0 AND c_mktsegment = 'MACHINERY') AND c_nationkey % 11 <> 0 GROUP BY ALL),
a AS (SELECT * FROM v WHERE seg = 'BUILDING'), b AS (SELECT * FROM v WHERE seg = 'MACHINERY')
SELECT n_nationkey AS qid, n_name AS heading, CASE WHEN a.k IS NULL AND b.k IS NULL THEN 'not_disclosed' WHEN a.k IS NULL OR b.k IS NULL THEN 'partial' WHEN a.unit <> b.unit THEN 'unit_mismatch' ELSE 'compared' END AS status,
CASE WHEN a.unit = b.unit THEN round(a.value - b.value, 2) END AS abs, CASE WHEN a.unit = b.unit THEN CASE WHEN a.value > b.value THEN 'up' WHEN a.value < b.value THEN 'down' ELSE 'flat' END END AS direction
FROM nation LEFT JOIN a ON n_nationkey = a.k LEFT JOIN b ON n_nationkey = b.k"""
)
def compare_rows(spark, sf_dir):
    """A checklist of nations, asked of two segments."""
    k = F.col("c_nationkey")
    c = t(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~((k % 5 == 0) & (F.col("c_mktsegment") == "MACHINERY")) & (k % 11 != 0))
    v = c.groupBy(k.alias("qid"), "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("value"))
    v = v.select("qid", "c_mktsegment", "value", F.format_string("%.2f", "value").alias("raw"), F.when((F.col("qid") % 4 == 0) & (F.col("c_mktsegment") == "BUILDING"), "percent").otherwise("million").alias("unit"), F.lit(1).alias("page"), F.lit(1).alias("block_id"))
    side = lambda s: v.filter(F.col("c_mktsegment") == s).drop("c_mktsegment")
    items = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("heading"))
    return brief.compare_rows(side("BUILDING"), side("MACHINERY"), items).select("qid", "heading", "status", F.round("abs", 2).alias("abs"), "direction")


@query(
    """WITH c AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, floor(o_totalprice)::BIGINT % 97 AS k FROM orders),
r AS (SELECT *, CASE WHEN k % 13 = 5 THEN NULL WHEN k % 3 = 0 THEN '' ELSE 'told ' || k END AS value FROM c),
u AS (SELECT *, min(CASE WHEN value IS NULL THEN n END) OVER (PARTITION BY doc_id) AS stop, count(*) FILTER (value <> '') OVER (PARTITION BY doc_id ORDER BY n) AS so_far FROM r)
SELECT doc_id, n, value AS content FROM u WHERE value <> '' AND (stop IS NULL OR n < stop) AND so_far <= 4"""
)
def provider_quota(spark, sf_dir):
    """Up to four contents for each customer's orders, asked of a provider that fails by key and has nothing for others."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    c = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("n"), (F.floor("o_totalprice") % 97).cast("string").alias("key"))
    ask = lambda p: F.when(F.col(p).cast("int") % 13 != 5, F.when(F.col(p).cast("int") % 3 == 0, "").otherwise(F.concat(F.lit("told "), p)))
    store = stores.text_cache(spark, f"{shared_dir(spark)}/proofloom/replies-{uuid.uuid4().hex[:12]}")
    return enrich.within_quota(c.withColumn("prompt", F.col("key")), ask, store, cap=4)


# --- measures ----------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT DISTINCT o_custkey AS qid, o_orderkey % 3 AS doc_id, month(o_orderdate)::INT AS page FROM orders WHERE o_orderkey % 4 <> 0), g AS (SELECT DISTINCT o_custkey AS qid, o_orderkey % 3 AS doc_id, month(o_orderdate)::INT AS page FROM orders WHERE o_custkey % 5 <> 0 AND o_orderkey % 2 = 0),
f AS (SELECT qid, count(*) AS f FROM g SEMI JOIN r USING (qid, doc_id, page) GROUP BY 1), n AS (SELECT qid, count(*) AS n FROM g GROUP BY 1), q AS (SELECT DISTINCT qid FROM r UNION SELECT qid FROM n)
SELECT qid, CASE WHEN n > 0 THEN round(coalesce(f, 0) / n, 6) END AS recall FROM q LEFT JOIN n USING (qid) LEFT JOIN f USING (qid)"""
)
def page_recall(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 3).alias("doc_id"), F.month("o_orderdate").alias("page"), F.col("o_orderkey").alias("k"))
    return evals.recall(o.filter("k % 4 <> 0").drop("k"), o.filter("qid % 5 <> 0 and k % 2 = 0").drop("k"))


@query("SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) / greatest(count(*) FILTER (o_orderkey % 3 = 0), 1), 6) AS share, round(count(*) FILTER (o_orderstatus = 'F' AND o_orderkey < 0) / greatest(count(*) FILTER (o_orderkey < 0), 1), 6) AS none FROM orders GROUP BY 1")
def subset_rates(spark, sf_dir):
    o, hit = t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F"
    return o.groupBy("o_orderpriority").agg(evals.share(hit, F.col("o_orderkey") % 3 == 0).alias("share"), evals.share(hit, F.col("o_orderkey") < 0).alias("none"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS correct FROM events")
def judge_verdicts(spark, sf_dir):
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("CORRECT", "Incorrect, I fear", "It is correct.", "unsure")]), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, sf_dir, "events").select("event_id", evals.judge_says_correct(verdict).alias("correct"))


@query(f"WITH {EVIDENCE}, {CLAIMS} SELECT qid, claim FROM claims WHERE qid NOT IN (SELECT qid FROM evidence WHERE page = 1)")
def cases_without_failed(spark, sf_dir):
    failed = evidence(spark, sf_dir).filter("page = 1").select("qid").distinct()
    return stores.without_failed(claims(spark, sf_dir).select("qid", "claim"), failed, "qid")


@query(
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN 'b' END AS bucket, CASE WHEN event_id % 3 = 1 THEN 'x.txt' WHEN event_id % 3 = 0 THEN event_type || event_id % 7 || '.pdf' END AS name FROM events),
d AS (SELECT DISTINCT name FROM p WHERE event_id % 3 = 0)
SELECT left(sha256(text), 16) AS doc_hash, min(doc_id) AS doc_id FROM (SELECT n_nationkey AS doc_id, n_name AS text, (SELECT min(event_type) FROM events) || n_nationkey % 9 || '.pdf' AS name FROM nation) f WHERE name IN (SELECT name FROM d) GROUP BY 1"""
)
def pushed_documents(spark, sf_dir):
    """Documents that push messages name, each content once."""
    e, k = t(spark, sf_dir, "events"), F.col("event_id")
    m = S.push_target(e.select(F.when(k % 3 != 2, "b").alias("bucket_attr"), F.when(k % 3 == 1, "x.txt").when(k % 3 == 0, F.concat("event_type", k % 7, F.lit(".pdf"))).alias("object_attr"), F.lit(None).cast("string").alias("data")))
    first = e.agg(F.min("event_type")).first()[0]
    files = t(spark, sf_dir, "nation").select(F.lit("b").alias("bucket"), F.concat(F.lit(first), F.col("n_nationkey") % 9, F.lit(".pdf")).alias("name"), F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("text"))
    named = files.join(m.filter("verdict = 'take'").select("bucket", "name").distinct(), ["bucket", "name"], "left_semi")
    empty = spark.createDataFrame([], "doc_hash string, status string")
    return S.unseen(named, empty)


@query(f"WITH {EVIDENCE}, {CLAIMS} SELECT qid, claim, left(text, 12) AS text, verified FROM (SELECT qid, claim, text, false AS verified FROM claims) WHERE claim = 1")
def unsupported_claims(spark, sf_dir):
    """The claims with a figure that nobody has are not verified."""
    c = claims(spark, sf_dir)
    checked = verify.check(c.select("qid", "claim", "text"), c, evidence(spark, sf_dir)).filter("claim = 1")
    return checked.join(c.select("qid", "claim", F.left("text", F.lit(12)).alias("text")), ["qid", "claim"]).select("qid", "claim", "text", "verified")
