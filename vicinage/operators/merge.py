"""Neighbour tables (query_id, rank, neighbor_id, dist): merging, deduplication, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("query_id", "rank", "neighbor_id", "dist")


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, rank from 1: by distance, then neighbor_id. Spark limits the rows
    of a query in each task before the shuffle, so a query with very many candidates is no hot key."""
    order = Window.partitionBy("query_id").orderBy("dist", "neighbor_id")
    ranked = pairs.select("query_id", "neighbor_id", "dist").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "dist")


def dedup(pairs: DataFrame) -> DataFrame:
    """One entry, the nearest, for each query and neighbour."""
    return pairs.groupBy("query_id", "neighbor_id").agg(F.min("dist").alias("dist"))


def merge_neighbors(*tables: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of the union of neighbour tables; one table merges with
    itself, which sorts it and drops repeats."""
    if not tables:
        raise ValueError("nothing to merge")
    pairs = reduce(DataFrame.unionByName, [t.select("query_id", "neighbor_id", "dist") for t in tables])
    return top_k(dedup(pairs), k)


def nest(table: DataFrame) -> DataFrame:
    """(query_id, nbrs): neighbours as one array a query, nearest first."""
    held = table.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "dist"))).alias("x"))
    return held.select("query_id", F.transform("x", lambda n: F.struct(n["neighbor_id"].alias("neighbor_id"), n["dist"].alias("dist"))).alias("nbrs"))


def unnest(table: DataFrame) -> DataFrame:
    return table.select("query_id", F.posexplode("nbrs").alias("pos", "n")).select("query_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("n.neighbor_id").alias("neighbor_id"), F.col("n.dist").alias("dist"))


def row_topk(df: DataFrame, values: str, k: int, id_col: str = "id") -> DataFrame:
    """(id, rank, pos, val): the k smallest of each row's array; ties by position, NaN last."""
    marked = F.transform(values, lambda v, i: F.struct(v.alias("val"), i.alias("pos")))
    smallest = df.select(F.col(id_col).alias("id"), F.posexplode(F.slice(F.array_sort(marked), 1, k)).alias("r", "x"))
    return smallest.select("id", (F.col("r") + 1).cast("long").alias("rank"), F.col("x.pos").cast("long").alias("pos"), F.col("x.val").cast("double").alias("val"))


def sort_rows(df: DataFrame, values: str, id_col: str = "id") -> DataFrame:
    """Whole rows sorted, with positions: row_topk without a bound."""
    return row_topk(df, values, 2**31 - 1, id_col)


def first_columns(table: DataFrame, k: int) -> DataFrame:
    return table.filter(F.col("rank") <= k)
