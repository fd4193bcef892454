"""Connected components of links between classes, by spreading the smallest label and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node of its component.

    Each round every node takes the smallest label around it, then the label of its label, until none changes: labels only fall,
    so it ends.  Whether a label has changed is all that reaches the driver.
    """
    both = saved(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links"
    )
    labels = saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(labels.toDF("other", "c"), "other").groupBy("node").agg(F.min("c").alias("c"))
        low = labels.join(near, "node", "left").select("node", "comp", F.least("comp", "c").alias("low"))
        jump = labels.toDF("low", "far")
        new = saved(
            low.join(jump, "low", "left").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("comp")).alias("moved")),
            "labels",
        )
        labels = new.select("node", "comp")
        if not new.where("moved").take(1):
            return labels
