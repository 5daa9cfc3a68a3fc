"""Products of sparse matrices given as entries, (group, i, k, av) by (group, k, j, bv) with a shared k.

A product most of whose entries are there is made in cells where packed rows meet: shuffles carry the
factors, and no product of two entries is a row. One with few entries is a join with partial sums."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import round_half_up
from .search import Entries, sparse_dots
from .twins import GRAIN, STRIP, apart, mirrored

#: Rows of a tile, tiles of a side of a cell at most; pairs of entries an entry of the product, above which it goes through cells.
ROWS, SIDE, CROWDED = 1024, 8, 1 / 8
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def product(left: DataFrame, right: DataFrame, group: tuple[str, ...] = (), *, mirror: bool = False, digits: int | None = None) -> DataFrame:
    """(group, i, j, val) of the i and j that share a k. ``mirror`` is for a product with its own
    transpose: one triangle is computed. ``digits`` rounds val, halves away from zero."""
    plain = all(isinstance(df.schema["k"].dataType, WHOLE) and isinstance(df.schema[v].dataType, T.DoubleType) for df, v in ((left, "av"), (right, "bv")))
    if plain and _crowded(left, right, group):
        return cells(_rows(left, group, "i", "av"), _rows(right, group, "j", "bv"), group, mirror=mirror, digits=digits)
    pairs = left.join(right, [*group, "k"])
    if mirror:
        pairs = pairs.filter("i <= j OR i IS NULL")
    val = F.sum(F.col("av") * F.col("bv"))
    out = pairs.groupBy(*group, "i", "j").agg((val if digits is None else F.round(val, digits)).alias("val"))
    if mirror:
        both = F.when(F.col("i").eqNullSafe(F.col("j")), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
        out = out.select(*group, F.explode(both).alias("at"), "val").select(*group, "at.i", "at.j", "val")
    return out


def _crowded(left: DataFrame, right: DataFrame, group: tuple[str, ...]) -> bool:
    """Whether pairs of entries are many beside the places of the product."""
    a, b = (df.groupBy(*group, "k").agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "n"), (right, "m")))
    pairs = a.join(b, [*group, "k"]).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    places = _sizes(left, right, group).agg(F.sum(F.col("n_i").cast("double") * F.col("n_j"))).first()[0] or 0
    return pairs > 0 and pairs >= CROWDED * places


def _sizes(left: DataFrame, right: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, n_i, n_j): rows of both sides."""
    a, b = (df.groupBy(*group).agg(F.countDistinct(x).alias(f"n_{x}")) for df, x in ((left, "i"), (right, "j")))
    return a.join(b, list(group)) if group else a.join(b, F.lit(True))


def _rows(entries: DataFrame, group: tuple[str, ...], of: str, val: str) -> DataFrame:
    """(group, of, e): the entries of a row as an array."""
    return entries.filter(F.col("k").isNotNull()).groupBy(*group, of).agg(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), F.col(val).alias("v"))).alias("e"))


def multiply_whole(left: DataFrame, right: DataFrame, row_ids: DataFrame, col_ids: DataFrame, digits: int | None = None, mirror: bool = False) -> DataFrame:
    """The product on its whole grid of row_ids (i) by col_ids (j), 0 where it has no entry. The grid is the
    result asked for. ``mirror`` is for a product with its own transpose on its own ids."""
    sides = []
    for ids, entries, of, val in ((row_ids, left, "i", "av"), (col_ids, right, "j", "bv")):
        held = _rows(entries.select(of, "k", F.col(val).cast("double").alias(val)), (), of, val)
        sides.append(ids.select(of).join(held, of, "left").select(of, F.coalesce("e", F.array().cast("array<struct<k:bigint,v:double>>")).alias("e")))
    return cells(*sides, whole=True, mirror=mirror, digits=digits)


def cells(left: DataFrame, right: DataFrame, group: tuple[str, ...] = (), *, whole: bool = False, mirror: bool = False, digits: int | None = None) -> DataFrame:
    """The product of rows (group, i, e) and (group, j, e). Rows are dealt to tiles by a hash of their
    ids, and squares of tiles are the tasks' cells, so no key gathers a side. With ``mirror`` only the
    cells of one triangle meet, and an entry and its mirror image are written near each other (twins.py)."""
    sizes = _sizes(left, right, group).select(*group, *[F.greatest(F.lit(1), F.ceil(F.col(n) / ROWS)).cast("long").alias(t) for n, t in (("n_i", "t_i"), ("n_j", "t_j"))])
    target = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if group:
        pairs = sizes.agg(F.sum(F.col("t_i") * F.col("t_j"))).first()[0] or 1
        left, right = left.join(sizes, list(group)), right.join(sizes, list(group))
    else:
        t_i, t_j = sizes.first()
        pairs = t_i * t_j
        left, right = (df.withColumn("t_i", F.lit(t_i)).withColumn("t_j", F.lit(t_j)) for df in (left, right))
    side = max(1, min(SIDE, math.isqrt(pairs // (min(GRAIN, target) if mirror else target))))

    def tiles(df: DataFrame, of: str, other: str, own: str, cross: str) -> DataFrame:
        dealt = df.withColumn(f"at_{of}", F.pmod(F.xxhash64(of), F.col(f"t_{of}"))).groupBy(*group, f"at_{of}", f"t_{other}")
        packed = dealt.agg(F.collect_list(F.struct(F.col(of).alias("id"), "e")).alias(f"rows_{of}"))
        first, last, at = F.lit(0).cast("long"), F.floor((F.col(f"t_{other}") - 1) / side), F.floor(F.col(f"at_{of}") / side)
        others = F.sequence(first, last) if not mirror else F.sequence(at, last) if of == "i" else F.sequence(first, at)
        return packed.select(*group, f"at_{of}", f"rows_{of}", F.floor(F.col(f"at_{of}") / side).alias(own), F.explode(others).alias(cross))

    keys, parts = [*group, "cell_i", "cell_j"], max(1, min(target, -(-pairs // side**2)) if not mirror else apart(target, pairs // side**2))
    types = [left.schema[g] for g in group] + [T.StructField("i", left.schema["i"].dataType), T.StructField("j", right.schema["j"].dataType), T.StructField("val", T.DoubleType())]
    a, b = tiles(left, "i", "j", "cell_i", "cell_j"), tiles(right, "j", "i", "cell_j", "cell_i")
    met = a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys)
    if mirror:
        met = met.filter("at_i <= at_j")

    def meet(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                (i, x, x_held), (j, y, y_held) = (_unpack(batch.column(c)[n].values) for c in ("rows_i", "rows_j"))
                same = mirror and batch.column("at_i")[n].as_py() == batch.column("at_j")[n].as_py()
                if same:  # the other side's rows may lie in another order
                    j, y, y_held = i, x, x_held
                own = [batch.column(g)[n] for g in group]
                for at in range(0, x.n, 256):
                    end = min(at + 256, x.n)
                    val, there, known = _multiplied(x.part(at, end), y, x_held.part(at, end), y_held, whole)
                    val = val if digits is None else round_half_up(val, digits)
                    if not mirror:
                        yield _entries(own, i.slice(at, end - at), j, val, there, known, group)
                        continue
                    for a in range(at, end, STRIP):
                        part = slice(a - at, min(a + STRIP, end) - at)
                        ids, place = mirrored(i.slice(a, part.stop - part.start), j, there[part], a if same else None)
                        yield _batch(own, ids[0], ids[1], val[part].ravel()[place], None if known is there or known.all() else ~known[part].ravel()[place], group)

    return met.select(*group, "at_i", "at_j", "rows_i", "rows_j").mapInArrow(meet, T.StructType(types))


def _unpack(rows: pa.StructArray) -> tuple[pa.Array, Entries, Entries]:
    """(ids, entries, where entries are: 1, or 0 for an entry that is null) of a tile."""
    ids, e = rows.flatten()
    sizes, (k, v) = np.diff(np.asarray(e.offsets)), e.flatten().flatten()
    cols, held = k.to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)
    return ids, Entries(sizes, cols, v.fill_null(0.0).to_numpy(zero_copy_only=False)), Entries(sizes, cols, held.astype(float))


def _multiplied(x: Entries, y: Entries, x_held: Entries, y_held: Entries, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, which are entries, which are not null)."""
    val = sparse_dots(x, y)
    if whole:
        return val, (yes := np.ones(val.shape, bool)), yes
    known = sparse_dots(x_held, y_held) > 0
    if x_held.val.all() and y_held.val.all():
        return val, known, known
    one = [Entries(np.bincount(m.row, minlength=m.n), m.col, np.ones(len(m.col))) for m in (x, y)]
    return val, sparse_dots(*one) > 0, known


def _entries(own: list, i: pa.Array, j: pa.Array, val: np.ndarray, there: np.ndarray, known: np.ndarray, group: tuple[str, ...]) -> pa.RecordBatch:
    row, col = np.nonzero(there)
    return _batch(own, i.take(pa.array(row)), j.take(pa.array(col)), val[there], None if known is there or known.all() else ~known[there], group)


def _batch(own: list, i: pa.Array, j: pa.Array, val: np.ndarray, null: np.ndarray | None, group: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.repeat(g, len(i)) for g in own], i, j, pa.array(val, mask=null)], [*group, "i", "j", "val"])
