"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import scratch


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Alternating large-star and small-star rounds, each a shuffle of the edges
    that are left, until they no longer change: O(log n) rounds for any shape
    of graph, a chain included. Every round is written to the shared folder.
    Edges with a null end and loops are ignored; no edges give an empty table.
    """
    kind = edges.schema[a].dataType
    left = F.greatest(edges[a], edges[b]).cast(kind)
    right = F.least(edges[a], edges[b]).cast(kind)
    current = scratch.materialise(
        edges.where(edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b])).select(left.alias("u"), right.alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        per_node = Window.partitionBy("u")
        star = both.withColumn("m", F.least("u", F.min("v").over(per_node)))
        large = star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.where("v < u and m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.withColumn("m", F.min("v").over(per_node))
        small = low.select("u", F.col("m").alias("v")).unionByName(low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        done, current = current, scratch.materialise(small, "edges")
        scratch.release(done)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))
