"""Connected components of a table of links, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, discard, materialize


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link to another.

    Rounds of taking the smallest label among neighbours, then jumping to the label's own label;
    each round is written to the shared folder. Hubs are hot keys: their labels are broadcast, at
    most a thousand of them, and minima are combined before they shuffle. Null ends and links of a
    node to itself are no links.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, "cc-edges")
    total = edges.count()
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree"))
    labels = materialize(labels, "cc-labels")
    while True:
        seen = attach_groups(edges, labels.select(F.col("a"), F.col("label"), F.col("degree")), "a", "degree", total)
        offered = seen.groupBy("b").agg(F.min("label").alias("offer"))
        mine = labels.join(offered, labels["a"] == offered["b"], "left").select("a", "degree", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        mine = materialize(mine, "cc-offers")
        jumps = mine.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(mine.select(F.col("a").alias("label"), F.col("label").alias("next")), "label")
        jumps = materialize(jumps, "cc-jumps")
        moved = attach_groups(mine, jumps, "label", "n", total).select("a", "degree", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        moved = materialize(moved, "cc-labels")
        changed = moved.filter("old <> label").limit(1).count()
        discard(labels, mine, jumps)
        labels = moved
        if not changed:
            discard(edges)
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
