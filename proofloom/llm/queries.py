"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, licenses, mixing, negatives, outliers, ppm, rollups, simhash, suffix_tree, surrogates, tokenfile, trie
from .common import scratch, table, tokenizer_file

MAX_REPEATS = 1.5
SURROGATE_KEY = "proofloom surrogate key 1"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return simhash.classes(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence labels of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("detections")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenfile.digests(spark, tokenfile.written(table(spark, sf_dir, "documents"), tokenizer_file()))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of entities replaced."""
    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), SURROGATE_KEY)


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each use of each document: doc_id, source, n_tokens, epoch, block, place."""
    used = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repeats=MAX_REPEATS)
    return used.select("row.doc_id", "row.source", "n_tokens", "epoch", "block", "place")


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and suffix-tree log10 probabilities of every document."""
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op8_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, end_word of every document and test item that align."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether rules and outlier test keep it."""
    return outliers.judged(table(spark, sf_dir, "documents"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, lang and tokenizer version after three batches: all documents inserted, words counted anew, toxic documents deleted.

    The first batch is sent twice, as after a lost acknowledgement.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = rollups.Rollup(spark, scratch(spark, "rollup"))
    for _ in range(2):
        store.apply("b1_insert", inserts=rollups.counted(docs))
    store.apply("b2_recount", revisions=docs.select("doc_id", "source", "lang", F.lit("words-1").alias("version"), rollups.solid_words().alias("n_tokens")))
    store.apply("b3_delete", deletes=labels.filter("toxic = 1").select("doc_id"))
    return store.totals()


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations, with its preorder interval."""
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return ppm.predicted(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for every anchor and positive."""
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_simhash_near_dedup, op2_license_scan, op3_token_files, op4_html_main_text, op5_pii_surrogates, op6_temperature_mixing,
        op7_suffix_tree_scores, op8_benchmark_alignment, op9_robust_outliers, op10_token_rollups,
        op11_conversation_trie, op12_language_id, op13_hard_negatives,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {
        "op6_temperature_mixing": mixing.ORACLE.replace("{repeats}", str(MAX_REPEATS)),
        "op10_token_rollups": rollups.ORACLE,
        "op11_conversation_trie": trie.ORACLE,
        "op13_hard_negatives": negatives.ORACLE,
    }
