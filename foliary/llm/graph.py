"""Connected components as DataFrame steps: large-star and small-star until only stars are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none."""
    if edges.groupBy("u").count().where("count > 1").isEmpty():
        return edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()
    return False


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node; root is the component's least node.

    Each step takes only a minimum for each node and a join on it, so a node with very many links
    needs no list of them anywhere; where there are very many, the join spreads them over several tasks.
    """
    edges = C.cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    for _ in range(rounds):
        if _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        rows, most = 2 * edges.count(), least.agg(F.max("n")).first()[0]
        joined = (lambda a, b, rows=rows: C.spread_join(a, b, "u", "v", "n", rows)) if most > C.MANY else (lambda a, b: a.join(b, "u"))
        large = joined(both, least).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = C.cut(small.where("u > v").distinct())
    else:
        raise RuntimeError(f"components aren't found in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
