"""Connected components of a graph of edges, by alternating large-star and small-star steps (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Up to so many edges the minima of a step are broadcast; beyond that they are written, so that the join deals out both
#: sides and Spark can split the rows of a node with very many edges.
MOST_BROADCAST = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label for each node of an edge: label is the smallest node of its component.

    Each round is written to the shared folder, so lineage stays short. Loops and repeated edges don't matter; no edges
    give an empty result. A step groups by one node and sends minima only; no component is gathered anywhere.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = store(edges, "edges"), None
    mark = [F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))]
    while (now := tuple(edges.agg(*mark).first())) != before and now[0]:
        before = now

        def beside(rows: DataFrame, minima: DataFrame, few: bool = now[0] <= MOST_BROADCAST) -> DataFrame:
            return rows.join(F.broadcast(minima) if few else store(minima, "minima"), "a")

        # large star: neighbours that are greater than a node are tied to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = beside(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = store(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
