"""Delta-maintained token counts by source, language and tokenizer version.

A store is a folder of three tables, each divided by batch:

    rows     signed facts: (doc_id, source, lang, version, n_docs, n_tokens), in buckets of the doc_id's hash
    totals   the same summed by source, lang and version
    commits  one row for a batch, written last: its name, its number of buckets, the batches it replaces

An insert adds a fact, a delete takes the fact that stands and a revision takes
the old and adds the new; what stands is the sum of a document's signed facts.
A batch whose commit is there is not applied again; one that broke off before
its commit is written anew, and until then no reader sees it. Reading the totals
takes the small sums only, however many documents there are.

A delete or revision reads the buckets of its own documents alone, and keeps
their facts before it sums any. A batch has a bucket for each ``FACTS`` of its
facts, in powers of two, so that the buckets of a small batch are unions of
those of a large one and one list of hash classes tells them all. ``compact``
folds the batches so far into one, so that the facts read do not grow with the
number of batches. A store has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, exists, identifier, remove, saved, small_batches, texts, trim
from .mixing import n_tokens
from .tokenfile import encoder

KEYS = ["source", "lang", "version"]
FACT = ["doc_id", *KEYS, "n_docs", "n_tokens"]
TYPES = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long"
FACTS = 1 << 20


def _summed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _bucket(n: int) -> Column:
    """Which of ``n`` buckets, a power of two, a document is in."""
    return F.xxhash64("doc_id").bitwiseAND(F.lit(n - 1)).cast("int")


class Rollup:
    """A store at ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, batch: str) -> str:
        return f"{self.path}/rows/batch={batch}"

    def _commits(self) -> dict[str, tuple[int, list[str]]]:
        """Number of buckets and replaced batches of each committed batch; one row for a batch."""
        if not exists(self.spark, f"{self.path}/commits"):
            return {}
        rows = self.spark.read.schema("batch string, buckets int, replaces array<string>").parquet(f"{self.path}/commits/*").collect()
        return {r.batch: (r.buckets, r.replaces) for r in sorted(rows)}

    def committed(self) -> list[str]:
        """Batches in the order of their names, those that a compaction has replaced included."""
        return list(self._commits())

    def _live(self) -> dict[str, int]:
        """Number of buckets of each batch that no compaction has replaced."""
        found = self._commits()
        gone = {b for _, replaced in found.values() for b in replaced}
        return {b: n for b, (n, _) in found.items() if b not in gone}

    def _facts(self, docs: DataFrame | None = None) -> DataFrame:
        """Signed facts: all, or those of the documents in ``docs`` (doc_id), read from their buckets alone."""
        by_size: dict[int, list[str]] = {}
        for b, n in self._live().items():
            by_size.setdefault(n, []).append(self._rows(b))
        out = self.spark.createDataFrame([], TYPES)
        most = max(by_size, default=1)
        classes = [] if docs is None else [r[0] for r in docs.select(_bucket(most)).distinct().collect()]  # one number for a bucket at most
        for n, paths in by_size.items():
            part = self.spark.read.schema(TYPES + ", batch string, bucket int").option("basePath", f"{self.path}/rows").parquet(*paths)
            if docs is not None:
                part = part.filter(F.col("bucket").isin(sorted({c & (n - 1) for c in classes})))
            out = out.union(part.select(*FACT))
        if docs is None:
            return out
        return out.join(docs, out["doc_id"].eqNullSafe(docs["doc_id"]), "left_semi")

    def standing(self, docs: DataFrame | None = None) -> DataFrame:
        """The facts that stand, of all documents or of those in ``docs`` (doc_id): FACT, one row for each document and group."""
        return _summed(self._facts(docs), FACT[:4]).filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        paths = [f"{self.path}/totals/{b}" for b in self._live()]
        schema = TYPES.replace("doc_id long, ", "")
        sums = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return _summed(sums, KEYS).filter("n_docs <> 0 or n_tokens <> 0")

    def _write(self, batch: str, rows: DataFrame, replaces: list[str]) -> None:
        """Facts in buckets, their sums, and last the commit."""
        for path in (self._rows(batch), f"{self.path}/totals/{batch}"):  # what an attempt without a commit has left
            if exists(self.spark, path):
                remove(self.spark, path)
        own = saved(_summed(rows, FACT[:4]), "facts")
        n = 1 << max(0, (own.count() - 1) // FACTS).bit_length()
        put = own.withColumn("bucket", _bucket(n))
        (put.repartition(n, "bucket") if n > 1 else put).write.partitionBy("bucket").parquet(self._rows(batch))
        _summed(own, KEYS).coalesce(1).write.parquet(f"{self.path}/totals/{batch}")
        drop(own)
        self.spark.createDataFrame([(batch, n, replaces)], "batch string, buckets int, replaces array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply a batch once; False if it was committed before.

        ``inserts``: FACT without n_docs; rows of one doc_id and version add up,
        repeated rows and null keys or counts (zero) included. ``deletes``:
        doc_id, and version if only that one goes; what does not stand is
        ignored. ``revisions``: FACT without n_docs, of which the source, lang
        and count replace what stands for the doc_id and version; where nothing
        stands it is an insert. A null doc_id is a document like others. Where
        a batch has several rows for what it deletes or revises, each counts
        once: of differing revisions the largest count holds. Deletes and
        revisions act on what stood before the batch, which goes once, also
        where both name it; the batch's own inserts and revisions then stand.
        """
        identifier(batch)
        if batch in self.committed():
            return False
        signed = [self.spark.createDataFrame([], TYPES)]
        fact = lambda df: df.select(F.col("doc_id").cast("long"), *KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        if inserts is not None:
            signed.append(fact(inserts))
        gone, held = [], []
        if deletes is not None:
            keys = [F.col(c).cast(t) for c, t in (("doc_id", "long"), ("version", "string")) if c in deletes.columns]
            gone.append(saved(deletes.select(*keys).distinct(), "deletes"))
        if revisions is not None:
            new = fact(revisions).groupBy("doc_id", "version").agg(F.max(F.struct("n_tokens", "source", "lang")).alias("x"))
            new = saved(new.select("doc_id", "x.source", "x.lang", "version", F.lit(1).cast("long").alias("n_docs"), "x.n_tokens"), "revisions")
            gone.append(new)
            signed.append(new)
        if gone:
            asked = gone[0].select("doc_id")
            for x in gone[1:]:
                asked = asked.union(x.select("doc_id"))
            stood = saved(self.standing(asked), "standing")
            for x in gone:
                same = stood["doc_id"].eqNullSafe(x["doc_id"])
                if "version" in x.columns:
                    same &= stood["version"].eqNullSafe(x["version"])
                held.append(stood.join(x, same, "left_semi"))
            out = held[0] if len(held) == 1 else held[0].union(held[1]).distinct()
            signed.append(out.select(*FACT[:4], (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        rows = signed[0]
        for x in signed[1:]:
            rows = rows.union(x.select(*FACT))
        self._write(batch, rows, [])
        for x in (*gone, *([stood] if gone else [])):
            drop(x)
        return True

    def compact(self, batch: str) -> bool:
        """Fold all committed batches into one of this name, once: the facts that stand. Folded names stay known, so none is applied again."""
        identifier(batch)
        if batch in self.committed():
            return False
        self._write(batch, self.standing(), list(self._live()))
        return True


def words_of(text: str = "text") -> Column:
    return n_tokens(text)


def plain_tokens(text: str = "text") -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """Facts of ``docs`` (doc_id, text, source, lang) under two tokenizers: white-space words ``words-1`` and ``plain-1``. One pass over the texts."""
    both = docs.select("doc_id", "source", "lang", F.explode(F.map_from_arrays(F.array(F.lit("words-1"), F.lit("plain-1")), F.array(words_of(), plain_tokens()))).alias("version", "n_tokens"))
    return both.select("doc_id", *KEYS, "n_tokens")


def encoded(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """Facts of ``docs`` (doc_id, text, source, lang) under tokenizers of the tokenizers library: a file for each version.

    Counts are of the ids of whole texts, without special tokens. Null and empty
    texts count zero. Each text is read once for all versions.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [t.decode() for t in texts(b.column(3))]
            for v, path in tokenizers.items():
                n = [len(x) // 4 for x in encoder(path)(whole)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v] * len(n), pa.string()), pa.array(n, pa.int64())], [*FACT[:4], "n_tokens"])
        trim()

    small_batches(docs.sparkSession)
    return own.mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


#: DuckDB's form of the registered query: insert all, revise the words to those with a plain character, delete the toxic.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, lang,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F][^\x20\x09-\x0D]*')), 0) AS w,
    coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) AS p
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
f AS (SELECT source, lang, 'words-1' AS version, w AS n FROM d UNION ALL SELECT source, lang, 'plain-1', p FROM d)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM f GROUP BY 1, 2, 3
"""


def solid_words(text: str = "text") -> Column:
    """White-space words with a letter, a digit or a character beyond ASCII in them."""
    plain = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    gap = r"[^\x20\x09-\x0D]"
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"{gap}*{plain}{gap}*")), F.lit(0)).cast("long")
