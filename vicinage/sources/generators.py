"""Synthetic point sets: every row depends on the seed and its id alone, whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import DENSE, SPARSE, _dense_table


def _rows(spark: SparkSession, n: int, make, schema: str, block: int = 4096) -> DataFrame:
    """n rows by blocks of ids; make(first id, rows) -> Arrow table. A block has its own generator."""
    def fill(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                first = k * block
                yield from make(first, min(block, n - first)).to_batches()

    return spark.range(-(-n // block)).mapInArrow(fill, schema)


def gaussian(spark: SparkSession, n: int, width: int, seed: int = 10) -> DataFrame:
    return _rows(spark, n, lambda first, m: _dense_table(np.random.default_rng([seed, first]).standard_normal((m, width)), first), DENSE)


def uniform(spark: SparkSession, n: int, width: int, seed: int = 10) -> DataFrame:
    return _rows(spark, n, lambda first, m: _dense_table(np.random.default_rng([seed, first]).random((m, width)), first), DENSE)


def spheres(spark: SparkSession, n: int, width: int, clusters: int = 10, intrinsic: int = 10, noise: float = 1e-2, seed: int = 10) -> DataFrame:
    """Clusters of n // clusters consecutive rows that lie on spheres: each cluster has ``intrinsic``
    coordinates of its own, in which a row is a gaussian direction of length 1, a few of them moved by
    one gaussian shift of the cluster; all other coordinates, and rows left over, are uniform noise."""
    rng = np.random.default_rng(seed)
    own = np.array([rng.choice(width, min(intrinsic, width), replace=False) for _ in range(clusters)])
    shift = np.zeros(own.shape)
    for c in range(clusters):
        shift[c, rng.integers(0, own.shape[1], 3)] = 2 * rng.standard_normal()
    share = max(1, n // clusters)

    def make(first: int, m: int) -> pa.Table:
        g = np.random.default_rng([seed, first])
        x = noise * g.random((m, width))
        kind = (np.arange(m) + first) // share
        inside = np.flatnonzero(kind < clusters)
        direction = g.standard_normal((len(inside), own.shape[1]))
        direction /= np.linalg.norm(direction, axis=1, keepdims=True)
        x[inside[:, None], own[kind[inside]]] = direction + shift[kind[inside]]
        return _dense_table(x, first)

    return _rows(spark, n, make, DENSE)


def sparse_rows(spark: SparkSession, n: int, width: int, avg_nnz: int, seed: int = 10, fixed: bool = False) -> DataFrame:
    """Gaussian entries in distinct columns, about ``avg_nnz`` a row (exactly, if fixed)."""
    def make(first: int, m: int) -> pa.Table:
        g = np.random.default_rng([seed, first])
        counts = np.full(m, avg_nnz) if fixed else g.poisson(avg_nnz, m)
        counts = np.minimum(counts, width)
        cols = np.concatenate([np.sort(g.choice(width, c, replace=False)) for c in counts]) if m else np.zeros(0)
        return pa.table({"id": pa.array(np.repeat(np.arange(m) + first, counts), pa.int64()), "col": pa.array(cols, pa.int32()), "val": pa.array(g.standard_normal(len(cols)), pa.float32())})

    return _rows(spark, n, make, SPARSE, 1024)


def sparse_density(spark: SparkSession, n: int, width: int, density: float, seed: int = 10) -> DataFrame:
    """Each entry kept with probability ``density``, with a value uniform below it."""
    def make(first: int, m: int) -> pa.Table:
        x = np.random.default_rng([seed, first]).random((m, width))
        row, col = np.nonzero(x < density)
        return pa.table({"id": pa.array(row + first, pa.int64()), "col": pa.array(col, pa.int32()), "val": pa.array(x[row, col], pa.float32())})

    return _rows(spark, n, make, SPARSE, 1024)


def with_queries(points: DataFrame, nq: int) -> tuple[DataFrame, DataFrame]:
    """(points, the first nq of them as queries)."""
    return points, points.filter(F.col("id") < nq)
