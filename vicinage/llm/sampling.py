"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """At most n rows of each group, those of smallest hash of ``key``: the same in every run.

    A group is first thinned by hash to about twice what is wanted, so ranking it is bounded work."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_all")).withColumnRenamed(group, "_group")
    share = (F.lit(2 * n + 50) / F.col("_all")) * F.lit(2.0**32)
    mark = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(2**32))
    thin = rows.join(counts, F.col(group).eqNullSafe(F.col("_group"))).filter(mark < share).drop("_group", "_all")
    order = Window.partitionBy(group).orderBy(F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(2**32)), key)
    return thin.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")
