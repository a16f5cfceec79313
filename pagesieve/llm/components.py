"""Connected components of an undirected edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import durable, release, remove, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node of the component.

    Every round a node takes the smallest label among its own, its neighbours'
    and that of the node its label names, so labels travel in doubling steps.
    Neighbourhoods are never gathered: a round is a minimum per node, joined
    back to one row a node.  Labels are written as files between the rounds:
    a checkpoint is estimated at the product of the sizes of what was joined,
    a number with twice as many digits every round, in all plans that follow.
    """
    both = durable(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    labels, folder = written(labels)
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("root").alias("their_root"))
        least = both.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("their_root").alias("least"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        after = labels.join(least, "node").join(jump, "root").select("node", F.least("root", "least", "jump").alias("root"), (F.least("least", "jump") < F.col("root")).alias("moved"))
        after, next_folder = written(after)
        remove(edges.sparkSession, folder)
        labels, folder = after.drop("moved"), next_folder
        settled = after.where("moved").isEmpty()
        release(edges.sparkSession)
        if settled:
            labels = durable(labels)
            remove(edges.sparkSession, folder)
            return labels
