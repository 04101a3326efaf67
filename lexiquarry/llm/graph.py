"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import Scratch


def least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the least node that it is linked with.

    Each round hangs the neighbours of a node under the least of them, in plain joins and aggregations that are
    combined before they are moved, and is written to the scratch folder; rounds grow with the logarithm of a
    component's size. Loops and repeated edges don't matter; an empty table gives no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before, k = scratch.keep(now, f"{name}-0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, k = state, k + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least(large), "u").select(F.col("v").alias("x"), "m").where("x <> m").union(least(large).select("u", "m"))
        now = scratch.keep(small.toDF("u", "v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
