"""The driver's tables seen as the engine's: documents as files, sources as projects, events as jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions.embedder import HashEmbedder, embed_column
from tessera.operators import keyword_index
from tessera.operators.chunking import WordWindowChunker, flat_segments
from tessera.session import spread

EMBEDDER = HashEmbedder(256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that is heavy on each of them."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source a project, each document a reference to its content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("project_id"), F.md5("text").alias("sha512"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), F.col("doc_id").alias("added_at"))


def files(spark: SparkSession, sf_dir: str, committed: bool = True) -> DataFrame:
    """Distinct contents as files; of the German ones none is committed unless all are asked for."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.where("lang != 'de'") if committed else docs
    first = docs.groupBy(F.md5("text").alias("sha512")).agg(F.min(F.struct("doc_id", "text", "source")).alias("d"))
    name = F.concat(F.col("d.source"), F.lit("-"), F.col("d.doc_id").cast("string"), F.lit(".txt"))
    return first.select(
        "sha512", name.alias("basename"), F.lit("txt").alias("ext"), F.concat(F.lit("/files/"), "sha512", F.lit(".txt")).alias("copied_path"), F.lit("text").alias("filetype"),
        F.octet_length("d.text").cast("bigint").alias("byte_len"), F.lit(None).cast("bigint").alias("page_count"), F.length("d.text").cast("bigint").alias("char_len"),
        F.size(F.regexp_extract_all("d.text", F.lit(r"(?U)(\S+)"), F.lit(1))).cast("bigint").alias("word_count"), F.lit("v1").alias("pipeline_version"), F.col("d.doc_id").alias("created_at"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("project_id")).agg(F.min("doc_id").alias("created_at")).select("project_id", F.upper("project_id").alias("name"), "created_at")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents wait for indexing, those of an odd id have failed."""
    docs = table(spark, sf_dir, "documents").where("lang = 'de'")
    status = F.when(F.col("doc_id") % 2 == 1, F.lit("error")).otherwise(F.lit("pending"))
    return docs.groupBy(F.col("source").alias("project_id"), F.md5("text").alias("sha512")).agg(F.min("doc_id").alias("doc_id")).select(
        "project_id", "sha512", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("source_path"), F.concat(F.lit("/files/"), "sha512").alias("copied_path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("basename"), F.lit("txt").alias("ext"), status.alias("status"), F.when(F.col("doc_id") % 2 == 1, F.lit("unreadable")).otherwise(F.lit("")).alias("error"), F.col("doc_id").alias("added_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50/10 windows of all documents, with an id made of document and window."""
    cut = WordWindowChunker().chunk(flat_segments(documents(spark, sf_dir)))
    return cut.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("id"), F.col("doc_id").cast("string").alias("sha512"), "source", "text", "char_start", "char_end", "page", "page_char_start")


_stored: dict[tuple[str, str], DataFrame] = {}


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with their vectors, as indexing leaves them: written once a session, read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = scratch.materialise(chunks(spark, sf_dir).withColumn("vector", embed_column(F.col("text"), EMBEDDER).cast("array<float>")), "chunks")
    return _stored[key]


_keywords: dict[tuple[str, str], keyword_index.KeywordIndex] = {}


def keywords(spark: SparkSession, sf_dir: str) -> keyword_index.KeywordIndex:
    """The trigram index of all documents, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _keywords:
        _keywords[key] = keyword_index.build(spread(table(spark, sf_dir, "documents")), id_col="doc_id")
    return _keywords[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("sha512"), F.col("embedding").alias("vector"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One row's vector, to be searched for."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]
