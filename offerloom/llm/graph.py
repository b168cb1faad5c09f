"""Distributed connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(src, dst)``.

    Each round points every node at its smallest neighbour, follows that pointer once more,
    and replaces both ends of each edge; edges within one label vanish, and when none is
    left a label is its component's smallest node.  Stars take one round, chains a number
    that grows with the logarithm of their length.  Every table is written to the shared
    folder, and each join is between two such tables, so a hub's rows can be split.
    Node values of any orderable type work; edges with a null end are ignored.
    """
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = materialise(clean.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = None
    while True:
        ends = pairs.select(F.col("src").alias("node"), F.col("src").alias("to")).union(pairs.select("dst", "src"))
        parents = materialise(ends.groupBy("node").agg(F.min("to").alias("parent")))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
            first = parents
        if parents.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        up = parents.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
        jumped = materialise(parents.join(up, parents["parent"] == up["mid"], "left").select("node", F.coalesce("top", "parent").alias("parent")))
        if parents is first:
            labels = jumped.select("node", F.col("parent").alias("label"))
        else:
            step = jumped.select(F.col("node").alias("label"), "parent")
            labels = materialise(labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label")))
        for end in ("src", "dst"):
            step = jumped.select(F.col("node").alias(end), "parent")
            pairs = pairs.join(step, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        pairs = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        pairs = materialise(pairs.distinct())
