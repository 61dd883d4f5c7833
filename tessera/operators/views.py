"""Roll-ups of catalogue and search results for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import counted, format_bytes
from tessera.operators.catalog import ERROR, PENDING


def manage_rows(files: DataFrame, jobs: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Indexed files and jobs of a project in one list with their state: indexed, indexing, queued or error."""
    done = files.select("sha512", "basename", F.lit("indexed").alias("state"), F.lit("").alias("error"), "byte_len", "page_count", "word_count")
    state = F.when(F.col("status") == ERROR, F.lit("error")).otherwise(F.lit("queued"))
    open_ = jobs
    if active is not None:
        open_ = jobs.join(active.select(F.col("sha512").alias("_active")).distinct(), F.col("sha512") == F.col("_active"), "left")
        state = F.when((F.col("status") == PENDING) & F.col("_active").isNotNull(), F.lit("indexing")).otherwise(state)
    return done.unionByName(open_.select("sha512", "basename", state.alias("state"), "error"), allowMissingColumns=True)


def row_stats(byte_len: Column, page_count: Column, word_count: Column) -> Column:
    """"12 KB · 3 pages · 450 words", parts that aren't known left out."""
    return F.concat_ws(" · ", format_bytes(byte_len), counted(page_count, "page"), counted(word_count, "word"))


def row_label(state: Column, error: Column) -> Column:
    return F.when(state == "indexing", "Indexing…").when(state == "queued", "Queued").when(state == "error", F.concat_ws(": ", F.lit("Failed"), F.when(error != "", error))).otherwise("Indexed")


def project_label(doc_count: Column, pending: Column, error: Column) -> Column:
    return F.concat_ws(" · ", counted(doc_count, "document"), F.when(pending > 0, F.concat(pending.cast("string"), F.lit(" queued"))), F.when(error > 0, F.concat(error.cast("string"), F.lit(" failed"))))


def indexing_state(jobs: DataFrame, active: bool = False) -> DataFrame:
    pending = F.count_if(F.col("status") == PENDING)
    return jobs.agg(pending.alias("pending"), (F.lit(active) | (pending > 0)).alias("indexing"))


def batch_stats(batches: DataFrame, millis: str, rows: str) -> DataFrame:
    """Totals of an embedding run; zeros for an empty one."""
    total = F.coalesce(F.sum(millis), F.lit(0))
    return batches.agg(
        total.cast("double").alias("total_ms"),
        F.round(F.coalesce(F.sum(rows) * F.lit(1000.0) / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("rows_per_second"),
        F.round(F.coalesce(F.avg(millis), F.lit(0.0)), 6).alias("avg_ms"),
        F.coalesce(F.min(millis), F.lit(0)).cast("double").alias("min_ms"),
        F.coalesce(F.max(millis), F.lit(0)).cast("double").alias("max_ms"),
    )


def with_camel_names(rows: DataFrame) -> DataFrame:
    """Rows as JSON text under camelCase names."""
    camel = lambda c: "".join(p if k == 0 else p.capitalize() for k, p in enumerate(c.split("_")))
    return rows.select(F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in rows.columns))).alias("json"))


def name_of(keys: DataFrame, names: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """Keys with their name, or the default."""
    return keys.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def padded_grid(rows: Column, width: Column) -> Column:
    """Rows of cells padded to one width with empty cells."""
    return F.transform(rows, lambda row: F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.coalesce(F.get(row, c), F.lit(""))))
