"""Intermediate tables in the folder that every executor can reach.

The folder is the one the cluster names in ``spark.checkpoint.dir``. A table
written here cuts lineage and survives the loss of any executor, which a block
kept on one executor's disk does not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of a local master.

    On a cluster without the setting there is no folder that is known to be
    shared, so this raises instead of guessing one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def release(*tables: DataFrame) -> None:
    """Remove tables of `materialise` that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df._written_to
        delete(spark, path)
        _written[:] = [(owner, p) for owner, p in _written if p != path]


def delete(spark: SparkSession, path: str) -> None:
    """Remove one path of the shared folder; a missing path is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Remove every table this driver has written with `spark`'s context."""
    for owner, path in list(_written):
        if owner.sparkContext is spark.sparkContext:
            delete(spark, path)
            _written.remove((owner, path))


@atexit.register
def _at_exit() -> None:
    for owner, path in _written:
        try:
            if owner.sparkContext._jsc is not None:
                delete(owner, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
