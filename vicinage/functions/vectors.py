"""Column expressions on dense vectors (arrays), in double precision, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two vectors of equal length."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def sqnorm(a: Column | str) -> Column:
    """Squared Euclidean norm."""
    return _total(F.transform(doubles(a), lambda x: x * x))


def norm(a: Column | str) -> Column:
    return F.sqrt(sqnorm(a))


def sqdist(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance as a sum of squares, which cannot be negative."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def dist(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(sqdist(a, b))


def clamp(d: Column | str, floor: float = 0.0) -> Column:
    """A distance from cancelling terms, 0 where it is not above ``floor``."""
    d = _col(d)
    return F.when(d > floor, d).otherwise(F.lit(0.0))


def normalize(a: Column | str) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    a = doubles(a)
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def project(a: Column | str, direction) -> Column:
    """Inner product with a literal direction."""
    return dot(a, F.array(*[F.lit(float(x)) for x in direction]))


def entries(df: DataFrame, id_col: str, vector: str, threshold: float | None = None) -> DataFrame:
    """Dense rows as sparse entries (id, col, val); with a threshold only those larger in size."""
    out = df.select(F.col(id_col).alias("id"), F.posexplode(doubles(vector)).alias("col", "val"))
    return out if threshold is None else out.filter(F.abs("val") > threshold)


def densify(points: DataFrame, width: int) -> DataFrame:
    """Sparse entries (id, col, val) as dense rows (id, embedding)."""
    held = points.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("double")).alias("embedding"))


def validate(df: DataFrame, vector: str, width: int | None = None) -> int:
    """The common length of all vectors; ValueError if they differ, are null or hold nulls."""
    row = df.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.count(F.when(F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull()), 1)).alias("bad")).first()
    if row["bad"] or row["low"] != row["high"] or (width is not None and row["low"] not in (None, width)):
        raise ValueError(f"vectors are not all of one length: {row.asDict()}, wanted {width}")
    return row["low"] or 0


def usable(vector: Column | str) -> Column:
    """Whether a vector is not null and every component is a finite number."""
    v = _col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usable_rows(df: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The rows that take part in searches: with an id and a usable vector."""
    return df.filter(F.col(id_col).isNotNull() & usable(vector))


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to digits after the point, halves away from zero as SQL does, and no negative zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**digits
        out = np.rint(scaled)
        half = np.abs(scaled - np.trunc(scaled)) == 0.5
        if half.any():
            out[half] = np.trunc(scaled[half]) + np.sign(scaled[half])
        out = out / 10.0**digits + 0.0
        return np.where(np.abs(scaled) < 2.0**52, out, x)


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles; ValueError for nulls and other lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    if column.null_count or values.null_count:
        raise ValueError("a vector is null or holds nulls")
    if (lengths != lengths[0]).any():
        raise ValueError("vectors are not all of one length")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)
