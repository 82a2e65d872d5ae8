"""Connected components of a link table, by rounds of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node of its component.

    Each round takes the least label among neighbours and then the label's own label, so long
    chains close in a logarithmic number of rounds. Each round is written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("lower"), F.col("label").alias("was"))
        lower = stored(lower, "labels-lower")
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("jump"))
        fresh = stored(
            lower.join(jump, "lower").select("node", F.least("lower", "jump").alias("label"), "was"), "labels")
        if fresh.where(F.col("label") != F.col("was")).isEmpty():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label")
