"""Row movement by key: gathers, owners, sizes, ranks. Spark's shuffles do the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def ordered_partitions(df: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """df range-partitioned by ``order``, its partition number as ``part``, written once so that the
    numbers stay as they are. Partitions are about equal in rows whatever the values' skew, as long
    as ``order`` is total."""
    ranged = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return materialize(ranged, "ordered")


def global_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Row numbers from 1 within groups of any size by a total order, no group in one task.

    Rows are range-partitioned by (group, order); a row's number is its place in its partition's
    share of the group plus the group's rows in earlier partitions."""
    parts = ordered_partitions(df, [F.col(c) for c in [*group, *order]], [*group, *order])
    counts = parts.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy(*group, "part").orderBy(*order)
    ranked = parts.withColumn("own", F.row_number().over(own)).join(counts, [*group, "part"])
    return ranked.withColumn(name, (F.col("offset") + F.col("own")).cast("long")).drop("own", "offset", "part")


def argsort(df: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """(pos, id): positions from 0 in ascending order of value, ties by id; NaN last, as in Spark."""
    ranked = global_rank(df.select(value, id_col), [], [value, id_col], "pos")
    return ranked.select((F.col("pos") - 1).alias("pos"), F.col(id_col).alias("id"))


def gather(data: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows of data for each requested key, once a request, wherever they are."""
    return wanted.select(key).join(data, key)


def permute(data: DataFrame, order: DataFrame) -> DataFrame:
    """Row permutation: order (pos, src) puts the row with id src at pos."""
    return order.join(data, F.col("src") == F.col("id")).drop("src", "id")


def redistribute(results: DataFrame, key: str = "query_id", order: tuple[str, ...] = ("query_id", "rank")) -> DataFrame:
    """Results back by key, each partition sorted."""
    return results.repartition(key).sortWithinPartitions(*order)


def owner(id_col: Column | str, bounds: list[int]) -> Column:
    """The block that owns an id, for ascending block starts (the first covers all below it)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.lit(0) + sum((F.when(c >= b, 1).otherwise(0) for b in bounds[1:]), F.lit(0))


def local_index(id_col: Column | str, bounds: list[int]) -> Column:
    """An id relative to its owner's start."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return c - F.element_at(F.array(*[F.lit(int(b)) for b in bounds]), owner(c, bounds) + 1)


def ordered_sizes(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, start, size) of the runs of equal keys."""
    return df.groupBy(key).agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("size"))


def block(df: DataFrame, id_col: str, start: int, stop: int) -> DataFrame:
    """Rows with start <= id < stop: a query set, a rank's block, a row cap."""
    return df.filter((F.col(id_col) >= start) & (F.col(id_col) < stop))


def sample_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)
