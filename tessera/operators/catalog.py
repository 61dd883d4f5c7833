"""The catalogue of projects, files, memberships and indexing jobs.

All operators are pure: they take tables and return the changed ones. `Catalog`
keeps the tables as versioned Parquet folders of one writer; a version becomes
current by one rename of a pointer file, so readers never see half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import scratch

SCHEMAS = {
    "projects": "project_id string, name string, created_at bigint",
    "files": "sha512 string, basename string, ext string, copied_path string, filetype string, byte_len bigint, page_count bigint, char_len bigint, word_count bigint, pipeline_version string, created_at bigint",
    "project_files": "project_id string, sha512 string, source_path string, added_at bigint",
    "index_jobs": "project_id string, sha512 string, source_path string, copied_path string, basename string, ext string, status string, error string, added_at bigint",
    "db_meta": "key string, value string",
    "chunks": "id bigint, sha512 string, text string, char_start bigint, char_end bigint, page bigint, page_char_start bigint, pipeline_version string, vector array<float>",
}
KEYS = {"projects": ["project_id"], "files": ["sha512"], "project_files": ["project_id", "sha512"], "index_jobs": ["project_id", "sha512"], "db_meta": ["key"], "chunks": ["id"]}
PENDING, ERROR = "pending", "error"


def scan(table: DataFrame, predicate: Column | None = None) -> DataFrame:
    return table if predicate is None else table.where(predicate)


def exists(table: DataFrame, predicate: Column) -> bool:
    return not table.where(predicate).isEmpty()


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` and those of `rows` whose key it lacks; the first of rows with equal keys."""
    return table.unionByName(absent(table, rows, keys))


def absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that insert_if_absent adds."""
    rest = [c for c in table.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*_ordered(rest), *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)) if rest else rows.dropDuplicates(keys)
    return first.join(table.select(*keys), keys, "left_anti").select(*table.columns)


def _ordered(columns: list[str]) -> list[Column]:
    return [F.col(c).alias(f"_o_{c}") for c in ("added_at", "created_at", "source_path") if c in columns]


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    return table.where(~F.coalesce(predicate, F.lit(False)))


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("value")


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(meta, meta.sparkSession.createDataFrame([(key, value)], SCHEMAS["db_meta"]), ["key"])


def ensure_project(projects: DataFrame, project_id: str, name: str, now: int) -> DataFrame:
    return insert_if_absent(projects, projects.sparkSession.createDataFrame([(project_id, name, now)], SCHEMAS["projects"]), ["project_id"])


def rename_project(projects: DataFrame, project_id: str, name: str) -> DataFrame:
    return projects.withColumn("name", F.when(F.col("project_id") == project_id, F.lit(name)).otherwise(F.col("name")))


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy("created_at", "project_id")


def add_file_ref(project_files: DataFrame, refs: DataFrame) -> DataFrame:
    """Memberships, the first source path and time of each kept."""
    return insert_if_absent(project_files, refs, KEYS["project_files"])


def ref_count(project_files: DataFrame) -> DataFrame:
    return project_files.groupBy("sha512").agg(F.count("*").alias("refs"))


def orphans(files: DataFrame, project_files: DataFrame) -> DataFrame:
    """Files that no project refers to."""
    return files.join(project_files.select("sha512"), "sha512", "left_anti")


def delete_project(projects: DataFrame, files: DataFrame, project_files: DataFrame, jobs: DataFrame, project_id: str) -> dict[str, DataFrame]:
    """The tables without the project, and the files and pending shas that nothing refers to any more."""
    gone = F.col("project_id") == project_id
    left, jobs_left = delete_where(project_files, gone), delete_where(jobs, gone)
    lost = orphans(files, left)
    used = left.select("sha512").unionByName(jobs_left.select("sha512"))
    bytes_lost = project_files.where(gone).select("sha512").unionByName(jobs.where(gone).select("sha512")).distinct().join(used, "sha512", "left_anti")
    return {"projects": delete_where(projects, gone), "files": files.join(left.select("sha512"), "sha512", "left_semi"), "project_files": left, "index_jobs": jobs_left, "orphans": lost, "unused_bytes": bytes_lost}


def remove_file_ref(files: DataFrame, project_files: DataFrame, project_id: str, sha512: str) -> dict[str, DataFrame]:
    """The tables without one membership; a file that nothing refers to any more goes with it."""
    left = delete_where(project_files, (F.col("project_id") == project_id) & (F.col("sha512") == sha512))
    this = files.where(F.col("sha512") == sha512)
    lost = orphans(this, left)
    return {"project_files": left, "files": files.join(lost.select("sha512"), "sha512", "left_anti"), "orphans": lost}


def list_project_files(project_files: DataFrame, files: DataFrame, project_id: str | None = None) -> DataFrame:
    """Memberships whose file is committed, in order of addition."""
    own = project_files if project_id is None else project_files.where(F.col("project_id") == project_id)
    return own.join(files, "sha512").orderBy("added_at", "sha512")


def list_documents(project_files: DataFrame, files: DataFrame, project_id: str | None = None) -> DataFrame:
    return list_project_files(project_files, files, project_id).select("sha512", "basename", "filetype", "page_count", "char_len", "word_count")


def known_and_new(incoming: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming files whose content is committed already, and the others."""
    return incoming.join(files.select("sha512"), "sha512", "left_semi"), incoming.join(files.select("sha512"), "sha512", "left_anti")


def dedup_by_content(incoming: DataFrame, order: str = "added_at", key: str = "sha512") -> DataFrame:
    """The first reference to each content."""
    names = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min(F.struct(F.col(order).alias("_o"), *names)).alias("_f"))
    return first.select(*(F.col(key) if c == key else F.col(f"_f.{c}").alias(c) for c in incoming.columns))


def enqueue(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs and the new ones as pending; a job that is there already, failed or not, stays as it is."""
    return insert_if_absent(jobs, rows.withColumn("status", F.lit(PENDING)).withColumn("error", F.lit("")), KEYS["index_jobs"])


def delete_job(jobs: DataFrame, project_id: str, sha512: str) -> DataFrame:
    return delete_where(jobs, (F.col("project_id") == project_id) & (F.col("sha512") == sha512))


def set_job_status(jobs: DataFrame, project_id: str, sha512: str, status: str, error: str = "") -> DataFrame:
    this = (F.col("project_id") == project_id) & (F.col("sha512") == sha512)
    return jobs.withColumn("status", F.when(this, F.lit(status)).otherwise(F.col("status"))).withColumn("error", F.when(this, F.lit(error)).otherwise(F.col("error")))


def retry_failed(jobs: DataFrame, project_id: str | None = None) -> DataFrame:
    """Failed jobs made pending again."""
    these = F.col("status") == ERROR
    these = these if project_id is None else these & (F.col("project_id") == project_id)
    return jobs.withColumn("error", F.when(these, F.lit("")).otherwise(F.col("error"))).withColumn("status", F.when(these, F.lit(PENDING)).otherwise(F.col("status")))


def next_pending_job(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == PENDING).orderBy("added_at", "project_id", "sha512").limit(1)


def jobs_for(jobs: DataFrame, project_id: str) -> DataFrame:
    return jobs.where(F.col("project_id") == project_id).orderBy("added_at", "sha512")


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("project_id").agg(F.count_if(F.col("status") == PENDING).alias("pending"), F.count_if(F.col("status") == ERROR).alias("error"))


def project_status(jobs: DataFrame, project_id: str, active: DataFrame | None = None) -> DataFrame:
    """The project's jobs; the one that is being indexed, if it is the project's own, marked active."""
    own = jobs_for(jobs, project_id)
    if active is None:
        return own.withColumn("active", F.lit(False))
    return own.join(active.select("project_id", "sha512").distinct().withColumn("active", F.lit(True)), ["project_id", "sha512"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def project_listing(projects: DataFrame, project_files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects with the number of memberships and of jobs by status."""
    members = project_files.groupBy("project_id").agg(F.count("*").alias("doc_count"))
    joined = projects.join(members, "project_id", "left").join(job_counts(jobs), "project_id", "left")
    return joined.select("project_id", "name", "created_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("doc_count", "pending", "error"))).orderBy("created_at", "project_id")


def requeue_all(jobs: DataFrame, files: DataFrame, project_files: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs with one for each membership of a committed file, no files, the number of memberships)."""
    again = project_files.join(files, "sha512").select("project_id", "sha512", "source_path", "copied_path", "basename", "ext", F.lit(now).cast("bigint").alias("added_at"))
    return enqueue(jobs, again), files.where(F.lit(False)), again.agg(F.count("*").alias("requeued"))


def max_id(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("max_id"))


def count_for(chunks: DataFrame, members: DataFrame) -> DataFrame:
    return chunks.join(members.select("sha512").distinct(), "sha512", "left_semi").agg(F.count("*").alias("n"))


def with_ids(rows: DataFrame, first: int, order: list[str]) -> DataFrame:
    """Contiguous ids from `first` in the order given, without a single-partition sort of the rows.

    Rows are range-partitioned and sorted; each partition's first id is the
    number of rows before it, taken from one small count by partition.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = scratch.materialise(placed, "ids")
    before = placed.groupBy("_p").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_base")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_n", own).join(F.broadcast(before), "_p").withColumn("id", F.lit(first) + F.col("_base") + F.col("_n")).drop("_p", "_n", "_base")


class Catalog:
    """The tables under one folder; commit() makes new versions of some of them current together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _pointer(self) -> dict[str, str]:
        at = self._path(f"{self.root}/current")
        if not self._fs.exists(at):
            return {}
        lines = self.spark.read.text(f"{self.root}/current").collect()
        return dict(r.value.split("=", 1) for r in lines if "=" in r.value)

    def table(self, name: str) -> DataFrame:
        version = self._pointer().get(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{name}/{v}" for v in version.split("+")))

    def commit(self, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Write new versions of the tables, and what is appended to others, then make all of it current at once.

        A version is one or more folders; appending adds one and leaves what is there alone.
        """
        now = self._pointer()
        for name, table, more in [*((n, t, False) for n, t in tables.items()), *((n, t, True) for n, t in (append or {}).items())]:
            folder = uuid.uuid4().hex
            table.select(*(F.col(f.split()[0]) for f in SCHEMAS[name].replace(", ", ",").split(","))).write.parquet(f"{self.root}/{name}/{folder}")
            now[name] = f"{now[name]}+{folder}" if more and now.get(name) else folder
        self._point(now)

    def _point(self, versions: dict[str, str]) -> None:
        made = self._path(f"{self.root}/.current-{uuid.uuid4().hex}")
        out = self._fs.create(made, True)
        out.write(bytearray("".join(f"{k}={v}\n" for k, v in sorted(versions.items())), "utf-8"))
        out.close()
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(made), self._fs.makeQualified(self._path(f"{self.root}/current")), how)

    def compact(self, name: str, files: int) -> None:
        """Rewrite a table into so many files and remove its older versions."""
        self.commit(**{name: self.table(name).repartition(files)})
        self.vacuum(name)

    def exists(self, path: str) -> bool:
        """Whether a file is there, in any file system that Spark reads."""
        at = self._path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def vacuum(self, name: str) -> None:
        current = (self._pointer().get(name) or "").split("+")
        folder = self._path(f"{self.root}/{name}")
        if self._fs.exists(folder):
            for status in self._fs.listStatus(folder):
                if status.getPath().getName() not in current:
                    self._fs.delete(status.getPath(), True)

    def drop(self, name: str) -> None:
        now = self._pointer()
        if now.pop(name, None):
            self._point(now)
        self.vacuum(name)
