"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import drop, store


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (x, y); comp is some node of its component, the same for all.

    Each round hooks every label to its least neighbour, follows the hooks twice, and keeps the edges whose ends still
    differ. Rounds are stored, so a lost executor costs one of them; the number of edges left is all that comes to the driver.

    Defined results: edges may repeat, in either direction; loops and edges with a null end are left out; no edges, no rows.
    """
    left = store(edges.select("x", "y").where("x <> y").distinct(), "cc-edges")
    labels = store(left.select(F.col("x").alias("node")).union(left.select("y")).distinct().withColumn("comp", F.col("node")), "cc-labels")
    old = labels
    while left.limit(1).count():
        both = left.union(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = store(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("y")), "cc-hooks")
        far = hook
        for _ in range(2):
            far = far.join(hook.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        labels = store(labels.join(far.withColumnRenamed("x", "comp"), "comp", "left").select("node", F.coalesce("y", "comp").alias("comp")), "cc-labels")
        ends = left.join(far.select("x", F.col("y").alias("p")), "x").select("y", "p").join(far.select(F.col("x").alias("y"), F.col("y").alias("q")), "y")
        last, left = left, store(ends.where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "cc-edges")
        drop(last, hook, old)
        old = labels
    return labels
