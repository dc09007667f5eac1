"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_salted, materialise


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u; salted, so that a node with very many edges is no long key.

    Merged, never broadcast: the table has a row for each node, and rounds of broadcasts would fill the executors.
    """
    return join_salted(edges.withColumn("_spread", F.xxhash64("v")), least.hint("merge"), ["u"], "_spread", salts=4)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (u, v), the root being its component's least node.

    Each round is written to the shared folder, so its lineage is one table. Rounds grow with the
    logarithm of the longest chain. Nodes without edges are not in the result.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    summary = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = summary(edges)
    for _ in range(most_rounds):
        edges = materialise(_small_star(_large_star(edges)), label)
        now = summary(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
