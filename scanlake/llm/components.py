"""Connected components of an edge table, by alternating large-star and small-star steps.

Labels are pulled to the smallest reachable node. Every step reads and writes a table in the shared folder,
so lineage stays short; nothing is collected. A step's joins are plain inner joins on a node, which adaptive
execution splits where a node has a large share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import removed, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them. Here u > v in each row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, a <> b). Returns node, root: a row for each node of an edge, with the smallest node it reaches."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = None
    for _ in range(MAX_ROUNDS):
        last, now = now, written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        removed(last)
        # the sum changes with every step that is not the last: labels only fall, edges only merge
        is_ = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
