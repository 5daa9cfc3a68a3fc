"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """(node, label) of every node of ``links``; label is the smallest node of its component.

    Every node takes the smallest label next to it, then the label of its label (which halves long
    chains), until nothing changes. Minima are combined before each shuffle, so a node with very
    many links is no hot key; nothing is collected. ``parts``: files of the tables in between, if their size is known."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = materialize(edges.union(edges.select("v", "u")).distinct(), "edges", parts)
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels", parts)
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("further"))
        moved = materialize(step.join(jump, F.col("label") == F.col("of"), "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels", parts)
        labels = moved.select("node", "label")
        if moved.filter("was <> label").isEmpty():
            return labels


def contract(labels: DataFrame, links: DataFrame, parts: int | None = None) -> DataFrame:
    """``labels`` (node, label) once the components named in ``links`` (two columns of labels) are one:
    the work is in proportion to the links between components, however large these are."""
    a, b = links.columns
    between = links.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    if between.isEmpty():
        return labels
    merged = components(between, parts=parts).select(F.col("node").alias("of"), F.col("label").alias("now"))
    moved = labels.join(merged, F.col("label") == F.col("of"), "left")
    return materialize(moved.select("node", F.coalesce("now", "label").alias("label")), "labels", parts)
