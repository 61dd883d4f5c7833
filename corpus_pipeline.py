"""The corpus pipeline: from raw documents to token ids, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

1. quality classifier: documents that are more likely bad than good go;
2. quality rules: documents with too much repetition go;
3. n-gram Jaccard join: of each group of near duplicates the least id stays;
4. mixing: each document stands as often as its source's target weight asks, counted in
   tokens of the vocabulary that the next stage encodes with;
5. BPE encoding: n_tokens and tokens in place of the text.

Defined results: null, empty and blank texts are rejected by stage 1, unless
there is nothing to learn from, and then pass every stage, once each; documents
without id are rows like any other; rows that repeat id and n-grams become one
in stage 3, rows that repeat an id with other texts are documents of their own;
null sources and languages are a source and a language; documents whose
similarity is exactly the threshold are one group, of which the least id stays;
an empty table passes through all stages; columns besides those of documents,
whatever their names, are passed on and take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import scratch
from tessera.llm import bpe, mixing, ngram_join, quality_classifier, quality_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, bpe_path=bpe.VOCABULARY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: The learned classifier and the Newton iterations have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
