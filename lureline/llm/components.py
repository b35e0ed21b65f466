"""Connected components by contraction: each round joins every node to the smallest node near it, until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of the edges a, b (long).

    Edges are halved at least with each round, so there are few. Sums and minima are combined before each shuffle; nothing but the
    number of edges left comes to the driver.
    """
    left = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select(F.col("b"), F.col("a")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        step = cut(near.join(near.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p")))
        named = left.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        left = cut(named.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            moved = labels.join(step.select(F.col("u").alias("label"), F.col("p")), "label", "left")
            labels = cut(moved.select("node", F.coalesce("p", "label").alias("label")))
    return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0) if labels is None else labels
