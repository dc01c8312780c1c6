"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import empty, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that ``links`` (a, b) names; a component is named by its least node.

    Each round hooks every label to its least neighbour, follows the hooks twice, and maps the links
    to the labels so reached; links within a label go. Labels only move to lesser ones of their
    component, and the least keeps its own. Links and labels stay in tables, written in every round;
    the driver only learns whether links are left.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not empty(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("_m")).select("label", F.least("label", "_m").alias("to")))
        for _ in range(2):
            onward = hooks.select(F.col("label").alias("_l"), F.col("to").alias("_to"))
            hooks = hooks.join(onward, hooks["to"] == onward["_l"]).select("label", F.col("_to").alias("to"))
        hooks = written(hooks)
        labels = written(labels.join(hooks, labels["component"] == hooks["label"], "left").select("node", F.coalesce("to", "component").alias("component")))
        left, right = (hooks.select(F.col("label").alias(f"_{k}"), F.col("to").alias(f"_{k}_to")) for k in "ab")
        edges = edges.join(left, edges["a"] == left["_a"]).join(right, edges["b"] == right["_b"])
        edges = edges.select(F.least("_a_to", "_b_to").alias("a"), F.greatest("_a_to", "_b_to").alias("b"))
        edges = written(edges.where("a <> b").distinct())
    return labels
