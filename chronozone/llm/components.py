"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, stored


def components(edges: DataFrame, folder: str) -> DataFrame:
    """The smallest node that each linked node can reach.

    ``edges`` has two long columns ``a`` and ``b`` (order and repeats don't matter; rows with a null end or
    equal ends link nothing).  Returns ``node, label`` for nodes that have a link to another node.  Each round takes
    the minimum label of a node's neighbours, then the label of that label, so chains shorten geometrically; labels only fall, so the rounds end.  Every
    round is a written table in ``folder``; only a count of changes reaches the driver.
    """
    spark = edges.sparkSession
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(both.union(both.select(F.col("b"), F.col("a"))).distinct(), f"{folder}/links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{folder}/label0")
    for k in count(1):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.a).select("node", "label", F.least("label", "near").alias("new"))
        up = step.select(F.col("node").alias("up"), F.col("new").alias("upper"))
        # a label is always a node of its component, so the second look-up finds a row
        jump = step.join(up, step.new == up.up).select("node", F.least("new", "upper").alias("label"), (F.least("new", "upper") != F.col("label")).alias("moved"))
        wide = stored(jump, f"{folder}/label{k}")
        moved = wide.where("moved").limit(1).count()
        drop_folder(spark, f"{folder}/label{k - 1}")
        label = wide.select("node", "label")
        if not moved:
            return label
