"""Connected components of a distributed graph, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it is connected with.

    Labels stay in tables; the driver sees one count a round.  Each round takes the least
    label of the neighbours and then the label of that label, so rounds grow with the
    logarithm of a component's width.  No edges give no rows.
    """
    both = work.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    for i in range(1, 200):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = work.save(step.join(jump, "low", "left").select("node", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")), f"{name}-{i}")
        labels = after.select("node", "root")
        if not after.filter("moved").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
