"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, stem: str = "labels") -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node of its component.

    ``edges`` (u, v) has been written. Each round takes the smallest label among the
    neighbours and then the label of that label, so paths shrink by half; counts per node
    are aggregated before the shuffle, so a node of any degree is fine. No links, no rows.
    """
    both = scratch.keep(edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("near"))).distinct(), f"{stem}_links")
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), f"{stem}0")
    turn = 0
    while True:
        turn += 1
        theirs = labels.select(F.col("node").alias("near"), F.col("label").alias("near_label"))
        around = both.join(theirs, "near").groupBy("node").agg(F.min("near_label").alias("low"))
        lower = labels.join(around, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = scratch.keep(lower.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was"),
                               f"{stem}{turn}")
        if stepped.filter(F.col("label") != F.col("was")).isEmpty():
            return stepped.select("node", "label")
        scratch.drop(f"{stem}{turn - 1}")
        labels = stepped.select("node", "label")
