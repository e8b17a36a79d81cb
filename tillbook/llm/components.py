"""Connected components by repeated contraction, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.plans.worktables import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    In a round each node hooks to its smallest neighbour if that is smaller, and edges are
    drawn between what was hooked to; those inside one tree vanish. A hub's neighbours are
    reduced to a minimum on the map side. Every round is written, so a lost executor costs
    a retry and the plan stays short. Null ends and loops are dropped.
    """
    left = _both_ways(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        hooks = materialize(
            left.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hooks"
        )
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(
                hooks.withColumnRenamed("a", "component"), "component", "left"
            ).select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
        contracted = (
            left.filter("a < b")
            .join(hooks.withColumnRenamed("to", "to_a"), "a")
            .join(hooks.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b")
            .filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
        left = _both_ways(contracted, "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels


def _both_ways(edges: DataFrame, label: str) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return materialize(edges.select(ends.alias("e")).select("e.a", "e.b"), label)
