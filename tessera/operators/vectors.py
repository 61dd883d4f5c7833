"""Vector arithmetic as expressions, exact nearest neighbours, centroids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions.embedder import QUERY_PREFIX, Embedder
from tessera.functions.query import WeightedTerm

MIN_NORM = 1e-8
#: Rows of a block of an all-pairs product: a pair of blocks has a matrix of 32 MB.
BLOCK_ROWS = 2_000
#: Queries that a task of it holds while it reads all rows, and pairs that wait to be merged into their best.
TASK_ROWS, WAITING = 16_000, 500_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def constant(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine_distance(vector: Column, query: Column) -> Column:
    """1 - cosine; 1 where either has no length."""
    norms = l2(vector) * l2(query)
    return F.when(norms > 0, F.lit(1.0) - dot(vector, query) / norms).otherwise(F.lit(1.0))


def in_scope(rows: DataFrame, members: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is among the members; no scope keeps all, an empty one none."""
    return rows if members is None else rows.join(members.select(key).distinct(), key, "left_semi")


def top_k(rows: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k rows nearest by cosine distance, ties by id, with distance and score; one pass and a top-k merge."""
    distance = F.greatest(F.round(cosine_distance(F.col(vector_col), constant(query)), 9), F.lit(0.0))
    near = rows.withColumn("distance", distance).orderBy("distance", id_col).limit(k)
    return near.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("distance"))))


def nearest_of_all(rows: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Of every row the k nearest others: (id, rank, other, distance), exact.

    Every pair has to be looked at, by products of blocks; what is shuffled and
    written is in proportion to the rows all the same.
    """
    return block_product_top_k(rows, rows, k, id_col, vector_col)


def block_product_top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k nearest of `rows` to each of `queries` by matrix products of blocks, an equal id left out.

    The rows are written once to the shared folder. A task holds some queries
    with their best rows so far, and reads all rows past them block by block.
    """
    spark = queries.sparkSession
    path = scratch.new_path(spark, "rows")
    rows.select(F.col(id_col).alias("b"), F.col(vector_col).alias("vb")).write.parquet(path)
    n, cores = queries.count(), spark.sparkContext.defaultParallelism
    tasks = max(-(-n // TASK_ROWS), min(2 * cores, -(-n // 250)), 1)
    kind = queries.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, TASK_ROWS):
            asked = _Asked(batch.column(0), _unit_rows(batch.column(1)), k)
            for block in _blocks(path):
                other = block.column("b")
                y = _unit_rows(block.column("vb"))
                for lo in range(0, len(other), BLOCK_ROWS):
                    asked.meet(other.slice(lo, BLOCK_ROWS), y[lo : lo + BLOCK_ROWS])
            yield asked.result(batch.schema.field(0).type)

    met = queries.select(F.col(id_col).alias("a"), F.col(vector_col).alias("va")).repartition(tasks).mapInArrow(run, f"a {kind}, rank int, b {kind}, distance double")
    return met.select(F.col("a").alias(id_col), "rank", F.col("b").alias("other"), "distance")


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of unit length; of length 0 where they are."""
    if not len(vectors):
        return np.zeros((0, 0))
    if vectors.null_count or len(vectors.value_lengths().unique()) > 1:
        raise ValueError("vectors must be there and of one length")
    x = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of `size` rows, and a last one of the rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder, some blocks at a time."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, root = pafs.FileSystem.from_uri(path)
    for found in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
        with fs.open_input_file(found) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=4 * BLOCK_ROWS)


class _Asked:
    """Queries and the best k rows that each has met, by distance, then id."""

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids.to_numpy(zero_copy_only=False), x, k
        self.kth = np.full(len(x), np.inf)
        self.query, self.other, self.distance = np.zeros(0, np.int64), self.ids[:0], np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, other: pa.Array, y: np.ndarray) -> None:
        other = other.to_numpy(zero_copy_only=False)
        for lo in range(0, len(self.x), BLOCK_ROWS):
            d = 1 - self.x[lo : lo + BLOCK_ROWS] @ y.T
            if d.shape[1] > 2 * self.k + 2:  # one more than k, as the query itself may be among them
                near = np.partition(d, self.k, axis=1)[:, self.k] if not np.isfinite(self.kth[lo : lo + BLOCK_ROWS]).all() else np.inf
                bound = np.minimum(self.kth[lo : lo + BLOCK_ROWS], near)
            else:
                bound = self.kth[lo : lo + BLOCK_ROWS]
            # distances are compared when rounded, and no less than 0, so all that could tie with the k-th stay in
            row, column = np.nonzero(d <= (np.maximum(bound, 0) + 2e-9)[:, None])
            self.waiting.append((row + lo, other[column], np.maximum(np.round(d[row, column], 9), 0)))
            self.held += len(row)
            if self.held > WAITING:
                self.settle()
        if self.waiting and not np.isfinite(self.kth).all():
            self.settle()

    def settle(self) -> None:
        query, other, distance = (np.concatenate([a, *b]) for a, b in zip((self.query, self.other, self.distance), zip(*self.waiting)))
        keep = self.ids[query] != other
        query, other, distance = query[keep], other[keep], distance[keep]
        order = np.lexsort((other, distance, query))
        query, other, distance = query[order], other[order], distance[order]
        first = np.searchsorted(query, np.arange(len(self.x)))
        best = np.arange(len(query)) - first[query] < self.k
        self.query, self.other, self.distance = query[best], other[best], distance[best]
        size = np.bincount(self.query, minlength=len(self.x))
        last = np.cumsum(size) - 1
        self.kth = np.where(size == self.k, self.distance[np.maximum(last, 0)] if len(self.distance) else np.inf, np.inf)
        self.waiting, self.held = [], 0

    def result(self, kind: pa.DataType) -> pa.RecordBatch:
        if self.waiting:
            self.settle()
        rank = np.arange(len(self.query)) - np.searchsorted(self.query, self.query) + 1
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query], kind), pa.array(rank.astype(np.int32)), pa.array(self.other, kind), pa.array(self.distance)], ["a", "rank", "b", "distance"])


def similarity_matrix(rows: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Dot products of all pairs of a small table."""
    one, two = rows.select(F.col(id_col).alias("a"), F.col(vector_col).alias("va")), rows.select(F.col(id_col).alias("b"), F.col(vector_col).alias("vb"))
    return one.crossJoin(two).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("similarity"))


def weighted_sum(weighted: DataFrame, vector_col: str = "vector", weight_col: str = "weight") -> DataFrame:
    """(pos, x): the components of the sum of weight * vector."""
    spread = weighted.select(F.col(weight_col).cast("double").alias("w"), F.posexplode(vector_col).alias("pos", "x"))
    return spread.groupBy("pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))


def unit(components: DataFrame) -> list[float] | None:
    """Components as a unit vector; None if there are none or they cancel out. As long as a vector."""
    found = [r.x for r in components.orderBy("pos").collect()]
    norm = float(np.linalg.norm(found)) if found else 0.0
    return [x / norm for x in found] if norm >= MIN_NORM and np.isfinite(norm) else None


def centroid(terms: list[WeightedTerm], embedder: Embedder, prefix: str = QUERY_PREFIX) -> list[float] | None:
    """The unit vector of a query's weighted terms; None if there are none or they cancel out."""
    if not terms or not embedder.dim:
        return None
    total = np.asarray([t.weight for t in terms]) @ np.asarray(embedder.embed([prefix + t.text for t in terms]), dtype=float)
    norm = float(np.linalg.norm(total))
    return (total / norm).tolist() if norm >= MIN_NORM and np.isfinite(norm) else None
