"""Connected components by smallest label, contracted round by round, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def _distinct_pairs(u: str | Column, v: str | Column, edges: DataFrame) -> DataFrame:
    return edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u <> v").distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of one ordered type, rows (node, label): the smallest node reachable, itself included.

    In each round every node points to the smallest node around it, and then to where that one points; edges
    move along to the nodes pointed to, and those that have become loops or repeat others go. So a dense group
    costs its edges about once, and the number of rounds grows with the logarithm of a component's width.
    Nodes without an edge do not appear. Rows with a null end and loops are left out; repeated edges count
    once; no edges give no rows.
    """
    pairs = materialize(_distinct_pairs("u", "v", edges.filter("u is not null and v is not null")), "cc-edges")
    labels = None
    while True:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")
        near = materialize(ends.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "cc-near")
        step = materialize(near.join(near.select(F.col("x").alias("to"), F.col("to").alias("further")), "to").select("x", F.least("to", "further").alias("to")), "cc-step")
        if labels is None:
            new = step.select(F.col("x").alias("node"), F.col("to").alias("label"))
        else:
            new = materialize(labels.join(step, F.col("label") == F.col("x"), "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        moved = pairs.join(step.select(F.col("x").alias("u"), F.col("to").alias("a")), "u").join(step.select(F.col("x").alias("v"), F.col("to").alias("b")), "v")
        moved = materialize(_distinct_pairs("a", "b", moved), "cc-edges")
        release(pairs)
        release(near)
        if labels is not None:  # the first round's labels are its steps
            release(labels)
            release(step)
        pairs, labels = moved, new
        if pairs.isEmpty():
            release(pairs)
            return labels


def joined_further(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of the components `labels` joined by further edges (u, v), whose ends may have no label yet."""
    at = lambda df, end: df.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    between = smallest_reachable(at(at(edges.select("u", "v"), "u"), "v"))
    to = between.select(F.col("node").alias("of"), F.col("label").alias("to"))
    known = labels.join(to, F.col("label") == F.col("of"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return known.unionByName(between.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti"))
