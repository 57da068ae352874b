"""Connected components over written tables, and the joins that growing components need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import Scratch, attach


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b: longs): the smallest node that it is connected with.

    Every round each node takes the smallest label among itself and its neighbours, then its
    label's label, so chains shorten by half. Hot nodes are pre-aggregated or split (``attach``).
    It ends when no neighbours differ.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    degrees = both.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    labels = scratch.write(degrees.select(F.col("b").alias("node"), F.col("b").alias("label"), "degree"), "labels")
    while True:
        seen = attach(both, labels.select(F.col("node").alias("b"), "label", "degree"), ["b"], "degree")
        least = seen.groupBy(F.col("a").alias("_node")).agg(F.min("label").alias("_least"))
        lower = labels.join(least, F.col("node") == F.col("_node"), "left")
        lowered = scratch.write(lower.select("node", F.least("label", "_least").alias("label"), "degree", (F.col("_least") < F.col("label")).alias("changed")), "lowered")
        scratch.drop("labels")
        if not lowered.filter("changed").limit(1).count():
            scratch.drop("edges")
            return lowered.select("node", "label")
        used = lowered.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
        jump = scratch.write(used.join(lowered.select(F.col("node").alias("label"), F.col("label").alias("next")), "label"), "jump")
        labels = scratch.write(attach(lowered, jump, ["label"], "rows").select("node", F.col("next").alias("label"), "degree"), "labels")
        scratch.drop("lowered", "jump")
