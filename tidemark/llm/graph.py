"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component; ``links`` has columns a, b.

    Every node takes the least label among its neighbours', then the label of its label, until nothing
    changes. Labels are written to the shared folder each round, so no lineage grows and a lost executor costs
    one round at most. Hot nodes are only keys of partial minima and of joins that AQE can split.
    """
    both = store.kept(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = store.kept(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("near")).agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["near"], "left").select("node", F.least("label", F.coalesce("least", "label")).alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("top"), F.col("label").alias("higher"))
        new = step.join(up, step["label"] == up["top"], "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label"), "old")
        new = store.kept(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
