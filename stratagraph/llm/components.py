"""Connected components by repeated contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.session import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b long); connected nodes share a label.

    Each round hooks every node to its smallest neighbour, renames the edges
    and drops loops; the number of edges falls by a constant factor, so there
    are logarithmically many rounds.  Each round is written to the shared folder.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialise(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y"))
        hook = materialise(hook, "hook")
        old_labels, old_left = labels, left
        labels = materialise(labels.join(hook, labels["label"] == hook["x"], "left").select("node", F.coalesce("y", "label").alias("label")), "labels")
        ha, hb = hook.toDF("x", "p"), hook.toDF("z", "q")
        left = left.join(ha, left["a"] == ha["x"]).join(hb, left["b"] == hb["z"]).where("p <> q")
        left = materialise(left.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        drop(old_labels, old_left, hook)
    drop(left)
    return labels
