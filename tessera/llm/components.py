"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): each step groups edges by one endpoint,
takes the smallest neighbour with a map-side combine, and joins it back. Edges
and smallest neighbours are written to the shared folder, so that the join has
shuffles of its own on both sides and Spark can split a hub's edges over tasks;
a step's tables are deleted when the next step's are written. Nodes of a number
type keep all aggregations in hash maps; others are sorted.
Only a count and a checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, release


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Undirected ``edges`` (a, b) to (node, label): the smallest node that each
    node in an edge reaches. Null endpoints and self loops are no edges."""
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(edges)
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        both = edges.union(edges.select("b", "a"))
        first = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        least = first.withColumnRenamed("a", "k")
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large-star")
        second = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        least = second.withColumnRenamed("a", "k")
        small = large.join(least, large["a"] == least["k"])
        pairs = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        old, edges = edges, cut(pairs.where("a <> b").distinct(), "small-star")
        release(old, first, large, second)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label")))
