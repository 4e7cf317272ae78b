"""Connected components by alternating stars, stored after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.session import stage


def _least(edges: DataFrame, of: str) -> DataFrame:
    return edges.groupBy("u").agg(F.min(of).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges, "v")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).filter("u > v")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component), for every node that has a link."""
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    before, now = None, _state(edges)
    while now != before:
        edges = stage(_small_star(_large_star(edges)).distinct())
        before, now = now, _state(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that ``roots`` came from and ``links``, stored.

    Only the roots that the new links join are gone over again, not every link.
    """
    def root_of(nodes: DataFrame, name: str) -> DataFrame:
        known = roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        return nodes.join(known, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))

    ends = stage(root_of(root_of(links.select("a", "b"), "a"), "b"))
    joined = components(ends.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    new = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
    every = roots.select("node", "root").unionByName(new.withColumn("root", F.col("node")))
    return stage(every.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
