"""Connected components of a graph given by its edges, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); the component is its smallest node.

    In each step a node takes the smallest label among its neighbours and
    itself, and then that label's own label, so chains shorten by half.  Every
    step is written out; nodes without an edge have no row, and an empty frame
    of edges gives none.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("least"))
        )
        low = labels.join(near, "node").select("node", F.least("component", "least").alias("low"), "component")
        low = stored(low, "labels")
        jumps = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        step = low.join(jumps, "low", "left").select(
            "node", F.coalesce("next", "low").alias("component"), (F.coalesce("next", "low") != F.col("component")).alias("moved")
        )
        step = stored(step, "labels")
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            return labels
