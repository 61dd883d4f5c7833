"""Session construction with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale. Sizes that depend on the cluster (executor
#: memory, shuffle partitions) stay with whoever submits the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.sortBeforeRepartition": "true",
}


def get_session(name: str = "tessera", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """The active session, or a new one with DEFAULTS, then `conf`, applied."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores, dealt out to all of them; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
