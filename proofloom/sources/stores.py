"""Stores as tables on any file system that Spark reaches: caches, blobs, index, traces, prompts, floors, reports.

A keyed store is a folder of sorted puts; the row of the highest version of a key
holds. A put is one committed write and one small file that names it, so a lost
executor costs a retry, and a reader sees whole puts only.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import latest

TRACES = 20


class KeyedStore:
    """Rows of ``schema`` by ``keys``; what is put last for a key holds.

    A put is a folder of sorted files and one small manifest entry with its
    version and each file's interval of first keys, which only one writer can
    create; so two writers lose nothing, and readers see whole puts. A look-up of
    some keys, or a scan of a prefix, opens the files whose interval has them. A
    removed key is a row of its own. Once a level has ``FANOUT`` puts they are
    merged, as files of an interval of keys each, into one of the next level, so
    that a key is in few files however many puts there were, and nothing is
    rewritten more than once a level. Files of merged puts stay for their readers.
    """

    FANOUT = 8

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.names = spark.createDataFrame([], schema).columns
        self.stored = f"{schema}, _gone boolean, _version long"

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def entries(self) -> list[dict]:
        """What holds now: a row for each put or merge, oldest first."""
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        found = [json.loads(r[0]) for r in self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.path}/manifest").collect()]
        merged = {v for e in found for v in e.get("of", [])}
        return sorted((e for e in found if e["id"] not in merged), key=lambda e: e["version"])

    def _add(self, rows: DataFrame, version: int | None, level: int, of: list[int]) -> dict:
        """Write rows, and their entry under the next free id."""
        name, first = f"data/{uuid.uuid4().hex}", F.col(self.keys[0]).cast("string")
        own = rows.repartitionByRange(*self.keys) if level else rows  # a put may be costly to work out, and ranges look at it twice
        own.sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{name}")
        told = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").groupBy(F.input_file_name().alias("f")).agg(F.min(first), F.max(first)).collect()  # a row for each file
        files = sorted([f.rsplit("/", 1)[1], a, b] for f, a, b in told)
        fs, p = self._fs()
        while True:
            new = 1 + max((int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")), default=0) if fs.exists(p) else 1
            try:
                out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(p, f"{new}.json"), False)  # fails where another writer was first
            except Py4JJavaError as e:
                if "exist" not in str(e.java_exception).lower():
                    raise
                continue
            entry = {"id": new, "version": new if version is None else version, "level": level, "of": of, "path": name, "files": files}
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
            return entry

    def _read(self, entries: list[dict], wanted=lambda low, high: True) -> DataFrame:
        """Rows of the files whose interval of first keys is ``wanted``, with the version of their put."""
        parts = []
        for e in entries:
            found = [f"{self.path}/{e['path']}/{f}" for f, low, high in e["files"] if wanted(low, high)]
            if found:
                own = self.spark.read.schema(self.stored).parquet(*found)
                parts.append(own.withColumn("_version", F.coalesce("_version", F.lit(e["version"]).cast("long"))))
        out = self.spark.createDataFrame([], self.stored)
        for part in parts:
            out = out.unionByName(part)
        return out

    def _put(self, rows: DataFrame, gone: bool) -> int:
        rest = [c for c in self.names if c not in self.keys]
        own = rows.select(*self.keys, *(F.lit(None).alias(c) if gone else F.col(c) for c in rest))
        one = own.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_x")).select(*self.keys, "_x.*") if rest else own.distinct()
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], self.stored).schema}
        entry = self._add(one.select(*(F.col(c).cast(kinds[c]).alias(c) for c in self.names), F.lit(gone).alias("_gone"), F.lit(None).cast("long").alias("_version")), None, 0, [])
        self.compact()
        return entry["version"]

    def put(self, rows: DataFrame) -> int:
        """Add or replace rows; their version. Of rows of one key in a put the largest in the order of columns holds."""
        return self._put(rows, gone=False)

    def remove(self, keys: DataFrame) -> int:
        """Take keys out; keys that are not there are no error."""
        return self._put(keys, gone=True)

    def _holds(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, "_version").filter("not _gone").select(self.names)

    def get(self) -> DataFrame:
        """The row that holds for each key."""
        return self._holds(self._read(self.entries()))

    def split(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``wanted`` with the stored columns where the store has its keys, and the rest of ``wanted``. Files without any of its first keys' interval stay closed."""
        low, high = wanted.agg(*(f(F.col(self.keys[0]).cast("string")) for f in (F.min, F.max))).first()
        have = self._holds(self._read(self.entries(), lambda a, b: low is not None and a is not None and a <= high and b >= low))
        return wanted.join(have, self.keys), wanted.join(have, self.keys, "left_anti")

    def scan(self, prefix: str, literal: bool = True) -> DataFrame:
        """Rows whose first key begins with ``prefix``. Not ``literal``: ``_`` and ``%`` in it stand for any character and any text."""
        key = F.col(self.keys[0]).cast("string")
        if not literal:
            fixed = re.split("[_%]", prefix)[0]
            return self._scanned(fixed).filter(key.like(prefix.replace("\\", "\\\\") + "%"))
        return self._scanned(prefix)

    def _scanned(self, prefix: str) -> DataFrame:
        key = F.col(self.keys[0]).cast("string")
        found = self._read(self.entries(), lambda a, b: a is not None and b >= prefix and a[: len(prefix)] <= prefix)
        return self._holds(found.filter(key.startswith(prefix)))  # what does not match is dropped before versions are compared

    def compact(self) -> None:
        """Merge the puts of each level that has FANOUT of them into one of the next. Removed keys go for good where nothing older is left."""
        level = 0
        while len(own := [e for e in self.entries() if e["level"] == level][: self.FANOUT]) == self.FANOUT:
            older = any(e["version"] < own[0]["version"] and e["id"] not in {x["id"] for x in own} for e in self.entries())
            rows = self._read(own)
            kept = latest(rows, self.keys, "_version").select(*self.names, "_gone", "_version")
            self._add(kept if older else kept.filter("not _gone"), own[-1]["version"], level + 1, [e["id"] for e in own])
            level += 1


def page_cache(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "doc_hash string, page int, parser string, blocks string", ("doc_hash", "page", "parser"))


def cached_pages(cache: DataFrame) -> DataFrame:
    """(doc_hash, parser, pages): the pages that a page cache has, sorted."""
    return cache.groupBy("doc_hash", "parser").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def text_cache(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "key string, value string", ("key",))


def blob_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "key string, content binary", ("key",))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, content) of the files under a folder of any store."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def upsert_index(index: DataFrame, chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``index`` with the documents of ``chunks`` indexed anew: what they had before goes, and so do old rows of a new chunk id.

    Of new rows of one chunk id the first by document and the other columns stays.
    """
    rest = [c for c in index.columns if c != "chunk_id"]
    new = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*rest), F.struct(by, F.to_json(F.struct(*rest)))).alias("_x")).select("chunk_id", "_x.*").select(index.columns)
    old = index.join(chunks.select(by).distinct(), by, "left_anti").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return old.select(index.columns).unionByName(new)


def has_vectors(index: DataFrame) -> bool:
    """Whether an index was written with vectors; one without is searched by terms alone, for good."""
    return "vector" in index.columns


def with_vectors(chunks: DataFrame, embedder=None) -> DataFrame:
    """``chunks`` with a vector column if an embedder is there and works on the first rows; else without."""
    if embedder is None:
        return chunks
    try:
        embedder.embed_docs([r[0] or "" for r in chunks.select("text").limit(1).collect()])
    except Exception:  # whatever the embedder raises: the index is built without vectors
        return chunks
    return embedded(chunks, embedder)


def embedded(chunks: DataFrame, embedder, batch: int = 96, text: str = "text") -> DataFrame:
    """``chunks`` with ``vector``, embedded ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in embedder.embed_docs(texts[k : k + batch])])

    return chunks.withColumn("vector", run(text))


# --- traces


def log_traces(traces: DataFrame, path: str) -> bool:
    """Append traces as JSON lines; False if that fails, which never fails the request."""
    try:
        traces.write.mode("append").json(path)
        return True
    except Exception:  # a trace is not worth an answer
        return False


def recent(traces: DataFrame, order: tuple[str, ...], line: str, n: int = TRACES) -> DataFrame:
    """The last ``n`` traces, newest first, without those among them that are no JSON."""
    last = traces.orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.filter(F.try_parse_json(line).isNotNull())


# --- prompts


def prompt(prompts: DataFrame, name: Column | str | None = None, version: int | None = None) -> DataFrame:
    """Prompts (name, version, template ...): the latest version of each name, or a pinned one. A name or version that is not there raises."""
    own = prompts if name is None else prompts.filter(F.col("name") == name)
    own = latest(own, ["name"], "version") if version is None else own.filter(F.col("version") == version)
    if name is not None and own.isEmpty():
        raise KeyError(f"no prompt {name!r}" + (f" of version {version}" if version is not None else ""))
    return own


_VARIABLE = re.compile(r"\$(?:(\$)|(\w+)|\{(\w+)\})")


def render(template: str, values: dict[str, Column | str]) -> Column:
    """A template's text with ``$name`` and ``${name}`` filled in from columns or literals; ``$$`` is a dollar. A missing value raises."""
    parts, at = [], 0
    for m in _VARIABLE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[2] or m[3]
        if name and name not in values:
            raise KeyError(f"missing variable {name!r}")
        value = values.get(name, "$")
        parts.append(value.cast("string") if isinstance(value, Column) else F.lit(value))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def chain(c: Column | str) -> Column:
    """The models of a comma-separated chain, without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


# --- floors and reports


def read_floors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, floor double").json(path)


def write_floors(floors: DataFrame, path: str) -> None:
    floors.select("metric", "floor").coalesce(1).orderBy("metric").write.mode("overwrite").json(path)


def table_report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; a result of more than ``most`` rows is no report and raises."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "—" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in found)]) + "\n"


# --- benchmark files


def load_cases(entries: DataFrame, listing: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Benchmark cases (qid, question, reference, category, answer_type, doc_name, gold_pages) whose document is in ``listing``.

    ``entries``: qid, query, answer, category, answer_type, from_pages (text).
    ``listing``: name of each PDF that is there. The document of an id is the
    longest file stem that begins it; without a listing, what stands before the
    page. Entries without question or document are dropped.
    """
    from .blocks import longest_prefix, page_numbers

    stems = listing.filter(F.lower("name").endswith(".pdf")).select(F.left("name", F.length("name") - 4).alias("stem"))
    found = longest_prefix(entries.withColumn("qid", F.coalesce("qid", F.lit(""))), stems)
    doc = F.concat(F.coalesce("stem", stem_of("qid")), F.lit(".pdf"))
    own = found.withColumn("doc_name", doc).filter((F.coalesce("query", F.lit("")) != "") & F.col("doc_name").isNotNull())
    own = own if categories is None else own.filter(F.col("category").isin(categories))
    own = own.join(listing.select(F.col("name").alias("doc_name")).distinct(), "doc_name", "left_semi") if not listing.isEmpty() else own
    pages = F.coalesce(page_numbers("from_pages"), F.array().cast("array<int>"))
    return own.select(
        "qid", F.col("query").alias("question"), F.coalesce("answer", F.lit("")).alias("reference"), F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("answer_type", F.lit("short")).alias("answer_type"), "doc_name", pages.alias("gold_pages"),
    )


def stem_of(qid: Column | str) -> Column:
    """The document's stem in an id of the forms stem_page.png-n and stem_multipage_a-b.png-n; null in others."""
    return F.nullif(F.regexp_extract(qid, r"^(.+?)_(?:multipage_[0-9]+(?:-[0-9]+)*|[0-9]+)\.png-[0-9]+$", 1), F.lit(""))


def without_failed(cases: DataFrame, failed: DataFrame, by: str = "doc_name") -> DataFrame:
    """The cases whose document was ingested."""
    return cases.join(failed, by, "left_anti")


def corpus_totals(results: DataFrame) -> DataFrame:
    """One row of totals over ingest results (doc_name, pages, chunks, enriched, skipped_pages array, error): failures count only by name."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, c)), F.lit(0)).cast("long")
    return results.agg(
        F.count_if(good).alias("docs"), total(F.col("pages")).alias("pages"), total(F.col("chunks")).alias("chunks"), total(F.col("enriched")).alias("enriched"),
        total(F.size(F.coalesce("skipped_pages", F.array().cast("array<int>")))).alias("skipped_pages"), F.sort_array(F.collect_set(F.when(~good, F.col("doc_name")))).alias("failed_docs"),
    )


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``seq``, their 0-based place within ``by``: events of one key in their order."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
