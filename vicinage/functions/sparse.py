"""Sparse matrices as entries: DataFrames (row, col, val) or, for points, (id, col, val).

Products are made in cells of packed rows, or, where few of their entries are there, by equi-joins on
the shared dimension with partial sums before the shuffle (operators/products.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_norms(points: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, sqnorm) of sparse rows; ids (id) adds the rows without entries at 0."""
    out = points.groupBy("id").agg(F.sum(F.col("val").cast("double") * F.col("val")).alias("sqnorm"))
    if ids is None:
        return out
    return ids.select("id").join(out, "id", "left").select("id", F.coalesce("sqnorm", F.lit(0.0)).alias("sqnorm"))


def multiply(a: DataFrame, b: DataFrame, digits: int | None = None) -> DataFrame:
    """Sparse product (i, j, val) of a (row, col, val) and b (row, col, val)."""
    from ..operators.products import product

    return product(*_factors(a, b), digits=digits)


def _factors(a: DataFrame, b: DataFrame, group: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    left = a.select(*group, F.col("row").alias("i"), F.col("col").alias("k"), F.col("val").alias("av"))
    return left, b.select(*group, F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("bv"))


def inner(q: DataFrame, r: DataFrame, digits: int | None = None) -> DataFrame:
    """(i, j, val): inner products of the rows of q with the rows of r that share a column; where both are
    the same frame, its gram()."""
    if q is r:
        return gram(rows(q), digits)
    return multiply(rows(q), transpose(rows(r)), digits)


def rows(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("row"), "col", "val")


def gram(a: DataFrame, digits: int | None = None) -> DataFrame:
    """A times its transpose: the upper triangle is computed, the lower mirrored."""
    from ..operators.products import product

    return product(*_factors(a, transpose(a)), mirror=True, digits=digits)


def inner_whole(q: DataFrame, r: DataFrame, q_ids: DataFrame, r_ids: DataFrame, digits: int | None = None) -> DataFrame:
    """inner() on the whole grid of q_ids (id) by r_ids (id), 0 where it has no entry. The grid is the result asked for."""
    from ..operators.products import multiply_whole

    return multiply_whole(*_factors(rows(q), transpose(rows(r))), q_ids.select(F.col("id").alias("i")), r_ids.select(F.col("id").alias("j")), digits, mirror=q is r and q_ids is r_ids)


def multiply_dense(points: DataFrame, columns: DataFrame) -> DataFrame:
    """Sparse times dense: points (id, col, val) by columns (col, level, weight) gives (id, level, proj).
    The dense factor of a projection is small (columns x levels); Spark broadcasts it if it is."""
    return points.join(columns, "col").groupBy("id", "level").agg(F.sum(F.col("val") * F.col("weight")).alias("proj"))


def multiply_blocks(a: DataFrame, b: DataFrame, digits: int | None = None) -> DataFrame:
    """Products of the diagonal blocks of block-diagonal matrices (block, row, col, val) in one pass."""
    from ..operators.products import product

    return product(*_factors(a, b, ("block",)), ("block",), digits=digits)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def offsets(a: DataFrame) -> DataFrame:
    """(row, start, nnz): where each row's entries begin in row order (rows with entries only)."""
    counts = a.groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))
    return prefix_sums(counts, "row", "nnz", "start").select("row", "start", "nnz")


def row_index(starts: DataFrame) -> DataFrame:
    """The inverse of offsets(): (row, pos), one row an entry."""
    return starts.filter("nnz > 0").select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("nnz") - 1)).alias("pos"))


def prefix_sums(df: DataFrame, key: str, value: str, name: str = "prefix") -> DataFrame:
    """Exclusive prefix sums of ``value`` in the order of the unique ``key``, without gathering the
    rows in one task: range partitions are summed by themselves and offset by the partitions before."""
    from ..operators.exchange import ordered_partitions

    parts = ordered_partitions(df.select(key, value), [F.col(key)], [key])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum(value).alias("total"))
    totals = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(totals), F.col("part") == F.col("of"))
    return out.select(key, value, (F.col("offset") + F.col("own")).alias(name))


def nnz_stats(points: DataFrame) -> DataFrame:
    """Average, largest and smallest number of entries of the rows that have any."""
    return points.groupBy("id").count().agg(F.avg("count").alias("avg_nnz"), F.max("count").alias("max_nnz"), F.min("count").alias("min_nnz"))
