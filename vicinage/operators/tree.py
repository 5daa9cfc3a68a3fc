"""Median-split trees: every level sorts each node's rows by one projection and halves them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sparse
from ..functions.vectors import doubles, dot, matrix
from .directions import directions_frame
from .exchange import global_rank, ordered_sizes

#: Rows of a node up to which one task sorts it; above, ranks come from range partitions.
NODE_ROWS = 1_000_000


def tree_levels(n: int, leafsize: int, most: int | None = None) -> int:
    """Levels so that leaves hold about ``leafsize`` rows, ``most`` at most."""
    if n < 1 or leafsize < 1:
        raise ValueError("n and leafsize must be positive")
    levels = math.ceil(math.log2(math.ceil(n / leafsize)))
    return levels if most is None else min(levels, most)


def project_dense(points: DataFrame, directions: np.ndarray, embedding: str = "embedding", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` and proj, an array of the projections of all levels, in one pass over the rows."""
    if not len(directions):
        return points.select(*keep, F.array().cast("array<double>").alias("proj"))
    e = doubles(embedding)
    return points.select(*keep, F.array(*[dot(e, F.array(*[F.lit(float(v)) for v in d])) for d in directions]).alias("proj"))


def project_blocks(points: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """(tree, id, proj) of several trees: one pass over (id, embedding), a matrix product a batch."""
    stacked = np.concatenate([d for d in directions.values()])
    cuts = np.cumsum([0] + [len(d) for d in directions.values()])

    def project(batches):
        for batch in batches:
            x = matrix(batch.column("embedding")) @ stacked.T
            for k, t in enumerate(directions):
                own = np.ascontiguousarray(x[:, cuts[k] : cuts[k + 1]])
                offsets = np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]
                proj = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), batch.column("id"), proj], ["tree", "id", "proj"])

    return points.select("id", "embedding").mapInArrow(project, "tree int, id long, proj array<double>")


def project_sparse(points: DataFrame, directions: np.ndarray, ids: DataFrame | None = None) -> DataFrame:
    """(id, proj) of sparse points (id, col, val); ids (id) adds rows without entries, at 0."""
    levels = len(directions)
    long = sparse.multiply_dense(points, directions_frame(points.sparkSession, directions))
    held = long.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("level", "proj"))).alias("m"))
    if ids is not None:
        held = ids.select("id").join(held, "id", "left")
    at = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.coalesce(F.element_at("m", l), F.lit(0.0))) if levels else F.array().cast("array<double>")
    return held.select("id", at.alias("proj"))


def assign_leaves(projected: DataFrame, levels: int, group: tuple[str, ...] = (), node_rows: int = NODE_ROWS) -> DataFrame:
    """(group, id, leaf_id): halve every node ``levels`` times.

    A node's first floor(n/2) rows by (projection, id) go left, to node 2v, the rest to 2v + 1. Nodes
    of at most ``node_rows`` rows are ranked by a window over their key; larger ones, at the top of
    large trees, by ranges, so no task ever holds a whole large node. Leaves differ by at most one
    row a level and every row is in one leaf."""
    keys = [*group, "leaf_id"]
    rows = projected.select(*group, "id", "proj", F.lit(0).cast("long").alias("leaf_id"))
    largest = None
    if levels:
        sizes = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        largest = int(sizes)
    for level in range(levels):
        rows = rows.withColumn("_p", F.element_at("proj", level + 1))
        size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        if largest > node_rows:
            rows = global_rank(rows, keys, ["_p", "id"], "_rank")
            sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
            rows = rows.join(F.broadcast(sizes), keys)
        else:
            rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_p", "id"))).withColumn("_size", size)
        right = (F.col("_rank") > F.expr("_size div 2")).cast("long")
        rows = rows.withColumn("leaf_id", F.col("leaf_id") * 2 + right).drop("_p", "_rank", "_size")
        largest = (largest + 1) // 2
    return rows.select(*group, "id", "leaf_id")


def local_leaves(proj: np.ndarray, ids: np.ndarray, levels: int) -> np.ndarray:
    """assign_leaves() for rows in memory: the same leaves, by numpy."""
    leaf = np.zeros(len(ids), np.int64)
    for level in range(levels):
        order = np.lexsort((ids, proj[:, level], leaf))
        node, start, size = np.unique(leaf[order], return_index=True, return_counts=True)
        place = np.arange(len(order)) - np.repeat(start, size)
        right = place >= np.repeat(size // 2, size)
        new = np.empty_like(leaf)
        new[order] = leaf[order] * 2 + right
        leaf = new
    return leaf


def leaf_intervals(leaves: DataFrame) -> DataFrame:
    """(leaf_id, start, size): rows in leaf order are numbered from 0; a leaf is one interval."""
    sizes = leaves.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("size"))
    return sparse.prefix_sums(sizes, "leaf_id", "size", "start").select("leaf_id", "start", "size")


def tree_order(leaves: DataFrame) -> DataFrame:
    """(pos, id, leaf_id): positions from 0 by leaf, then id."""
    ranked = global_rank(leaves.select("id", "leaf_id"), [], ["leaf_id", "id"], "pos")
    return ranked.select((F.col("pos") - 1).alias("pos"), "id", "leaf_id")


def grouped_leaves(leaves: DataFrame, order: DataFrame) -> DataFrame:
    """Intervals of leaves given positions (pos, leaf_id)."""
    return ordered_sizes(order, "leaf_id", "pos")


def node_medians(projected: DataFrame, leaves: DataFrame, levels: int) -> DataFrame:
    """(level, node, median): the smallest projection of each node's right half, so that a row is left
    exactly if its projection is below (ties at the median aside)."""
    rows = projected.join(leaves.select("id", "leaf_id"), "id")
    per = F.array(*[F.struct(F.lit(l).alias("level"), F.shiftright("leaf_id", levels - l).alias("node"), (F.shiftright("leaf_id", levels - l - 1) % 2).alias("side"), F.element_at("proj", l + 1).alias("p")) for l in range(levels)])
    long = rows.select(F.explode(per).alias("x")).select("x.*").filter("side = 1")
    return long.groupBy("level", "node").agg(F.min("p").alias("median"))


def bin_queries(projected: DataFrame, medians: DataFrame, levels: int) -> DataFrame:
    """(id, leaf_id): the leaf that each projected query falls into. Each level is an equi-join with
    that level's medians, a row a node, which Spark broadcasts while they are few. A node without a
    median (an empty right half) sends its queries left."""
    rows = projected.select("id", "proj", F.lit(0).cast("long").alias("leaf_id"))
    for level in range(levels):
        own = medians.filter(F.col("level") == level).select(F.col("node").alias("_node"), F.col("median").alias("_median"))
        right = F.coalesce((F.element_at("proj", level + 1) >= F.col("_median")).cast("long"), F.lit(0))
        rows = rows.join(own, F.col("leaf_id") == F.col("_node"), "left").select("id", "proj", (F.col("leaf_id") * 2 + right).alias("leaf_id"))
    return rows.select("id", "leaf_id")


def select_kth(df: DataFrame, value: str, k: int, id_col: str = "id") -> DataFrame:
    """(id, value) of the k-th smallest row (from 1) by value, ties by id, found by narrowing ranges of
    the values: no sort of all rows, and only the rows of one small range are ranked."""
    rows = df.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("value"))
    low, skipped = None, 0
    n = rows.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be from 1 to {n}")
    for _ in range(4):
        share = [(k - skipped - n // 100 - 1) / n, (k - skipped + n // 100 + 1) / n]
        cuts = rows.agg(F.percentile_approx("value", [min(1.0, max(0.0, s)) for s in share], 1000)).first()[0]
        inside = rows.filter(F.col("value").between(*cuts))
        below = rows.filter(F.col("value") < cuts[0]).count()
        count = inside.count()
        if below < k - skipped <= below + count and count < n:
            rows, skipped, n = inside, skipped + below, count
        else:
            break
    return rows.orderBy("value", "id").limit(k - skipped).orderBy(F.desc("value"), F.desc("id")).limit(1)


def projection_stats(projected: DataFrame, leaves: DataFrame, level: int, levels: int) -> DataFrame:
    """Size, mean, smallest and largest projection, left and right counts of the nodes of a level."""
    rows = projected.join(leaves, "id").select(F.shiftright("leaf_id", levels - level).alias("node"), F.element_at("proj", level + 1).alias("p"), (F.shiftright("leaf_id", levels - level - 1) % 2).alias("side"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.avg("p").alias("mean"), F.min("p").alias("low"), F.max("p").alias("high"), F.sum(1 - F.col("side")).alias("n_left"), F.sum("side").alias("n_right"))
