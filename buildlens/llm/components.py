"""Connected components by hooking and contraction, for graphs of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.shared import written


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of bigint nodes to (node, component), the least node of its component.

    In each round every node hooks onto its least neighbour, chains of hooks are halved until
    all nodes point at their root, and the edges are contracted to those between roots. A root
    that nothing happens to in one round has a lesser neighbour in the next, so every two
    rounds halve the roots, whatever the order of ids; the chains take a logarithm of their
    length. Each step is written to the shared folder. Nodes without an edge to another node
    do not appear.
    """
    edges = written(edges.where("a <> b").select(*_ordered("a", "b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "hooks")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(parent.join(up, "root").select("node", "root", "above"), "hooks-halved")
            done = jumped.where("root <> above").isEmpty()
            parent = jumped.select("node", F.col("above").alias("root"))
            if done:
                break
        if labels is None:
            labels = parent.select("node", F.col("root").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "root")
            labels = written(labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        ends = [parent.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in ("a", "b")]
        edges = written(edges.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(*_ordered("ra", "rb")).distinct(), "edges")
        if edges.isEmpty():
            return labels
