"""Sinks of neighbour tables and sparse matrices."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_graph(table: DataFrame, path: str) -> None:
    """A neighbour table as Parquet, by query."""
    table.write.parquet(path)


def write_truth(table: DataFrame, path: str) -> None:
    """A truth table as Parquet, for read-once reuse."""
    table.write.parquet(path)


def write_matrix_text(table: DataFrame, path: str) -> None:
    """A neighbour table as text: `M k`, then a line of ids a query, then a line of distances a query;
    queries in order, each with the same number of neighbours."""
    held = table.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "dist"))).alias("x"))
    ids = held.select(F.lit(1).alias("part"), "query_id", F.array_join(F.transform("x", lambda n: n["neighbor_id"].cast("string")), " ").alias("value"))
    dists = held.select(F.lit(2).alias("part"), "query_id", F.array_join(F.transform("x", lambda n: n["dist"].cast("string")), " ").alias("value"))
    head = held.agg(F.concat_ws(" ", F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).alias("value")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("query_id"), "value")
    lines = head.unionByName(ids).unionByName(dists).orderBy("part", "query_id").select("value")
    lines.coalesce(1).write.text(path)  # the format is one file


def csr_arrays(points: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, columns, values) on the driver, for the one-file formats."""
    t = points.orderBy("id", "col").select("id", "col", "val").toArrow()
    counts = np.bincount(t.column("id").to_numpy(), minlength=rows)
    return np.concatenate([[0], np.cumsum(counts)]).astype("<i4"), t.column("col").to_numpy().astype("<i4"), t.column("val").to_numpy().astype("<f4")


def write_csr_binary(points: DataFrame, path: str, rows: int, width: int) -> None:
    """Sparse points as one binary CSR file on a mounted path; larger sets belong in Parquet."""
    starts, cols, vals = csr_arrays(points, rows)
    with open(path, "wb") as f:
        f.write(struct.pack("<iii", rows, width, len(cols)) + starts.tobytes() + cols.tobytes() + vals.tobytes())


def write_csr_text(points: DataFrame, path: str, rows: int, width: int) -> None:
    starts, cols, vals = csr_arrays(points, rows)
    with open(path, "w") as f:
        for line in ([rows, width, len(cols)], starts.tolist(), cols.tolist(), [float(v) for v in vals]):
            f.write(" ".join(map(str, line)) + "\n")


def write_fvecs(points: DataFrame, path: str) -> None:
    """Dense points (id, embedding) in id order as records on a mounted path; larger sets belong in
    Parquet."""
    with open(path, "wb") as f:
        for r in points.select("id", F.col("embedding").cast("array<float>").alias("e")).orderBy("id").toLocalIterator():
            f.write(struct.pack("<i", len(r.e)) + np.asarray(r.e, "<f4").tobytes())


def write_sparse(points: DataFrame, path: str) -> None:
    """Sparse entries as Parquet, the form that scales."""
    points.write.parquet(path)


def write_svm(points: DataFrame, path: str) -> None:
    """Sparse points as LibSVM text (columns from 1, label 0), rows in id order."""
    rows = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("x"))
    text = F.concat_ws(" ", F.lit("0"), F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["col"] + 1, e["val"])), " "))
    rows.orderBy("id").select(text.alias("value")).write.text(path)


