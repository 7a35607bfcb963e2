"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Each round takes the least label among neighbours and then the label's label, so that chains
    shorten by half; labels are written each round. Neither edges nor labels reach the driver, only the
    number of labels that changed. A node with very many edges costs one row a task, as minima are combined
    before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = written(labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = written(lower.join(jump, "root").select("node", "old", F.least("root", "next").alias("root")), "labels")
        if labels.where("old <> root").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
