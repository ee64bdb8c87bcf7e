"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of `edges` (a, b: longs); component is the smallest reachable node.

    Each round hooks every node to its smallest neighbour below it, halves paths twice, and
    contracts the edges to the roots, dropping those inside one tree. Roots only ever move down, so
    the last label is the component's minimum. No step gathers a component in one task: groups
    aggregate map-side and joins carry one row per edge or node.
    Null ends and self-loops are ignored; no edges give no rows.
    """
    kept = scratch.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .distinct()
    )
    nodes = kept.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not kept.isEmpty():
        hook = kept.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))
        for _ in range(2):
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hook = hook.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        hook = scratch.keep(hook)
        labels = scratch.keep(
            labels.join(hook.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        )
        for end in ("lo", "hi"):
            kept = kept.join(hook.select(F.col("node").alias(end), "parent"), end, "left").withColumn(
                end, F.coalesce("parent", end)
            ).drop("parent")
        kept = scratch.keep(
            kept.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
        )
    return labels


def relabel(frame: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """`frame` with a `component` column for its `node`; a node without links is its own component."""
    known = labels.select(F.col("node").alias(node), "component")
    return frame.join(known, node, "left").withColumn("component", F.coalesce("component", node))
