"""Queries of the training-data operators over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import scratch
from tessera.llm import bpe, chat_tree, impact_search, license_scan, mixing, ngram_join, quality_classifier, quality_rules, simple8b, sql, warc
from tessera.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op2_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(warc.of_pages(_table(spark, sf_dir, "pages")), scratch.new_path(spark, "warc"))
    return warc.flat(warc.assemble(warc.read(spark, files)))


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_table(spark, sf_dir, "documents"))


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"))


def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.format_trees(_table(spark, sf_dir, "conversations"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


def op8_simple8b_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.learn(docs, _table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_impact_search": op2_impact_search,
    "op3_warc_transactions": op3_warc_transactions,
    "op4_repetition_coverage": op4_repetition_coverage,
    "op5_entropy_balanced_mix": op5_entropy_balanced_mix,
    "op6_chat_prefix_tree": op6_chat_prefix_tree,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_simple8b_output": op8_simple8b_output,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op2_impact_search": sql.IMPACT_SEARCH,
    "op3_warc_transactions": sql.WARC_TRANSACTIONS,
    "op4_repetition_coverage": sql.REPETITION_COVERAGE,
}
