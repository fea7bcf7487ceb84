"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Every round joins the edges with the smallest neighbour of each node and writes the rewired edges to
the shared folder, so lineage stays short and a lost executor costs one round at most. Minima are
aggregated before the shuffle, and the joins are sort-merge joins that Spark splits where one node
has very many edges; no neighbour list is ever collected.

Defined cases: edges with a null end and edges from a node to itself are left out (such nodes have
no other node in their component); repeated edges count once; no edges give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(others)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v: bigint) -> node, root: the smallest node reachable, for each node with an edge."""
    at = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(at)
    if before[0]:
        for _ in range(rounds):
            at = stored(_small_star(_large_star(at)).distinct(), "edges")
            now = _signature(at)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
