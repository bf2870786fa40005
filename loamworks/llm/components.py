"""Connected components of links, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, comp) for every node of a link; comp is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so that chains
    halve. Labels are written between rounds; they never pass through the driver, and rounds end when none changes.
    """
    both = common.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = common.materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("comp").alias("_was"), F.least("comp", "_near").alias("_to"))
        jump = labels.select(F.col("node").alias("_to"), F.col("comp").alias("_far"))
        new = step.join(jump.hint("merge"), "_to", "left").select("node", F.least("_to", F.coalesce("_far", "_to")).alias("comp"), "_was")
        new = common.materialise(new, "cc-labels")
        common.release(labels)
        changed = new.filter("comp <> _was").limit(1).count()
        labels = new.drop("_was")
        labels._written_to = new._written_to
        if not changed:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    common.release(both)
    return labels
