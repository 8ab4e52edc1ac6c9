"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import stored
from stratanet.session import dropped


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the least node that each reaches.

    Each round takes the least label among the neighbours and then the label of
    that label, so that long paths close in logarithmically many rounds. A
    round is written to shared storage, where a lost executor finds it again,
    and the round before is deleted.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = stored(both.where("node != other").distinct(), "component-edges")
    labels = last = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "component-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("least")), "other")
            .groupBy("node")
            .agg(F.min("least").alias("least"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "least").alias("component")
        )
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = stored(
            lower.join(above, "component").select("node", "was", F.least("component", "above").alias("component")),
            "component-labels",
        )
        dropped(last)
        labels, last = new.drop("was"), new
        if not new.where("was != component").take(1):
            dropped(both)
            return labels
