"""The corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns what it keeps.

All stages but the last return the columns of ``documents``. Mixing repeats the
documents of small sources, so a doc_id may then stand in several rows; the last
stage writes each of them to the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofloom.llm import decontam, mixing, outliers, simhash, tokenfile
from proofloom.llm.common import saved, table, tokenizer_file

#: How often the smallest source may be passed over while the largest is once; nothing is dropped for it.
MAX_REPEATS = 1.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the outlier test reject."""
    return outliers.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, whole or edited."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that sources come near to target weights."""
    return mixing.mixed(docs, max_repeats=MAX_REPEATS).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, from the written files."""
    return tokenfile.digests(spark, tokenfile.written(docs, tokenizer_file()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]
#: Robust estimates, fingerprints, alignments and tokenizer ids are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
