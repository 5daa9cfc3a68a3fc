"""How symmetric matrices are written: an entry and its mirror image are made together, near each other.

Spark writes a result of all pairs in the order in which tasks give the rows. Here RUN entries of a row are
followed by their mirror images in the same order, so that a page holds every value twice and
compression stores the second as a copy (Snappy finds copies only near by). Parquet packs bits of
eight values at a time, so runs are made of whole eights, and copies are whole eights apart."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a strip; entries of a run; tasks from which on cells grow instead of becoming more, because
#: a file's dictionary of values is shared by all its rows; bytes of such a dictionary.
STRIP, RUN, GRAIN, DICTIONARY = 32, 64, 64, 32 << 20


def share_values(spark: SparkSession) -> None:
    """Let Parquet files of this session hold dictionaries of up to DICTIONARY bytes (Parquet's own limit is
    1 MB), unless the session says otherwise: rounded values repeat, and a place in the dictionary is
    shorter than a double. The rows that are read are the same."""
    if spark.conf.get("parquet.dictionary.page.size", None) is None:
        spark.conf.set("parquet.dictionary.page.size", str(DICTIONARY))


def apart(target: int, cells: int) -> int:
    """Partitions for half of the cells of a square, so many that few get two by chance."""
    return max(1, min(max(target, 4 * GRAIN), cells))


def twice(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the matrix, whether it is the mirror image) of the entries that are there, each twice."""
    return _twice_all(there.shape) if there.all() else _twice(there)


@lru_cache(8)
def _twice_all(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return _twice(np.ones(shape, bool))


def _twice(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = there.shape[1] // RUN * RUN
    eights = (len(there), full // RUN, RUN // 8, 8)
    place = np.arange(there.size).reshape(there.shape)
    held = there[:, :full].reshape(eights).all(3).swapaxes(0, 1)
    even = place[:, :full].reshape(eights).swapaxes(0, 1)[held].ravel()
    rest = there.copy()
    rest.ravel()[even] = False
    odd = np.flatnonzero(rest)
    sizes = np.r_[8 * held.sum(2).ravel(), np.full(len(odd) // RUN, RUN), len(odd) % RUN // 8 * 8, len(odd) % 8].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    size, begin = np.repeat(sizes, 2 * sizes), np.repeat(begin, 2 * sizes)
    step = np.arange(len(size)) - 2 * begin
    image = step >= size
    return np.concatenate([even, odd])[begin + step - image * size], image


def mirrored(i: pa.Array, j: pa.Array, there: np.ndarray, at: int | None = None) -> tuple[tuple[pa.Array, pa.Array], np.ndarray]:
    """((ids of rows, ids of columns), place of the value in the strip) of the entries of a strip and of their
    mirror images. ``at`` is the strip's first row where i are rows of j itself: columns before it are
    left to the strips above."""
    if at is None:
        place, image = twice(there)
    else:
        own, right = np.flatnonzero(there[:, at : at + len(i)]), at + len(i)
        place, image = twice(there[:, right:])
        place = np.r_[_widened(own, len(i), at, there), _widened(place, there.shape[1] - right, right, there)]
        image = np.r_[np.zeros(len(own), bool), image]
    row, other = np.divmod(place, max(1, there.shape[1]))
    ids, other = pa.concat_arrays([i, j]), other + len(i)
    return (ids.take(pa.array(np.where(image, other, row))), ids.take(pa.array(np.where(image, row, other)))), place


def _widened(place: np.ndarray, width: int, begin: int, there: np.ndarray) -> np.ndarray:
    """Places in the columns from ``begin`` on, as places in the whole strip."""
    row, col = np.divmod(place, max(1, width))
    return row * there.shape[1] + col + begin
