"""Projection directions of trees: small dense matrices, made on the driver and sent as literals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

KINDS = ("gaussian_qr", "gaussian", "uniform_qr", "normalized")


def make_directions(width: int, levels: int, seed: int, kind: str = "gaussian_qr") -> np.ndarray:
    """(levels, width) unit directions, one for all nodes of a level.

    Orthonormal up to ``width`` of them; beyond that existing ones are drawn again. `gaussian` leaves
    them as drawn, `normalized` only scales them, which is what very wide data can afford."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    rng = np.random.default_rng(seed)
    fresh = min(width, levels)
    draw = rng.random((width, fresh)) if kind == "uniform_qr" else rng.standard_normal((width, fresh))
    if kind.endswith("qr"):
        draw = np.linalg.qr(draw)[0] if fresh else draw
    elif kind == "normalized":
        draw = draw / np.linalg.norm(draw, axis=0)
    order = np.concatenate([np.arange(fresh), rng.integers(0, max(fresh, 1), max(0, levels - fresh))]).astype(int)
    return draw.T[order] if levels else np.zeros((0, width))


def orthoproj(width: int, count: int, seed: int) -> np.ndarray:
    """(count, width): orthonormal as far as the width goes, plain gaussian beyond."""
    draw = np.random.default_rng(seed).standard_normal((width, count))
    fresh = min(width, count)
    draw[:, :fresh] = np.linalg.qr(draw[:, :fresh])[0]
    return draw.T


def directions_frame(spark: SparkSession, directions: np.ndarray) -> DataFrame:
    """(level, col, weight), the dense factor of a sparse projection."""
    rows = [(l, c, float(v)) for l, row in enumerate(directions) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "level int, col int, weight double")


def save_directions(spark: SparkSession, directions: np.ndarray, path: str) -> None:
    """Keep directions for a replay, as Parquet (level, direction)."""
    spark.createDataFrame([(l, row.tolist()) for l, row in enumerate(directions)], "level int, direction array<double>").write.parquet(path)


def load_directions(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.direction for r in spark.read.parquet(path).orderBy("level").collect()])
