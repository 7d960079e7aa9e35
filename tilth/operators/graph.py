"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.sources.shared import shared_dir


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component, the least node that edges (a, b) reach; nodes without an edge are their own. Each round takes the
    neighbours' least label and then that label's own, so chains close in a logarithm of their length."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = written(lower.join(up, "component", "left").select("node", "old", F.least("component", "above").alias("component")))
        labels = new.select("node", "component")
        if not new.where("component <> old").limit(1).count():
            return labels
