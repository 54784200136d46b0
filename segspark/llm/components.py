"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, not null); a component is named by its least node.

    Each round points every node at its least neighbour, follows the pointers once more, and contracts the edges
    onto what they point at; it ends when no edge is left. A chain loses at least half of its
    nodes in a round. Aggregates are partial, every round is written to the shared folder, nothing is collected.
    """
    edges = store(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        least = (
            edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                           F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x"))
            .groupBy("x.node").agg(F.min("x.other").alias("other"))
            .select("node", F.least("node", "other").alias("to"))
        )
        least = store(least, "pointers")
        to = lambda name: least.select(F.col("node").alias("_n"), F.col("to").alias(name))
        jumped = store(
            least.join(to("far"), F.col("to") == F.col("_n")).select("node", F.col("far").alias("to")), "pointers")
        to = lambda name: jumped.select(F.col("node").alias("_n"), F.col("to").alias(name))
        labels = store(
            labels.join(to("t"), F.col("component") == F.col("_n"), "left")
            .select("node", F.coalesce("t", "component").alias("component")), "labels")
        edges = store(
            edges.join(to("ta"), F.col("a") == F.col("_n")).drop("_n").join(to("tb"), F.col("b") == F.col("_n"))
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct(), "edges")
    return labels
