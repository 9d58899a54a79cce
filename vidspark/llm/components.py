"""Connected components of an edge table, by joins that never gather a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of ``edges`` (a, b).

    Every round a node takes the least label around it and then that label's own label, so that chains
    halve. Labels only fall, so the rounds come to an end, when none has. A node's neighbours meet only in partial minima, never as a list. Self-loops and repeated edges are allowed and change nothing; an
    edge with a null end is left out; No edges give no rows; other columns are not read.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = written(least.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        labels = moved.select("node", "label")
        if moved.filter(F.col("label") != F.col("was")).isEmpty():
            return labels
