"""Connected components of a link table, by alternating large and small stars with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import cut

ROUNDS = 60


def _mark(df: DataFrame) -> tuple:
    """Count and order-free checksum of a written table."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each linked node reaches. Nodes without links have no row.

    links hold two long columns in any order; loops and repeats are harmless. Each half round needs a
    minimum over neighbours (partial aggregation first) and a join that adaptive execution can split, so a
    node with very many neighbours is dealt out. Written tables between rounds cut the lineage.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "links")
    before = _mark(edges)
    for _ in range(ROUNDS):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        joined = large.join(least, F.col("u") == F.col("node"))
        star = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(star, "star")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
