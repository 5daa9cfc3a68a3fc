"""Exact and leaf-wise nearest neighbours, dense and sparse.

Results are neighbour tables (query_id, rank, neighbor_id, dist): squared Euclidean distance unless
``metric`` is `euclidean`, ascending, ties by neighbor_id, a row its own neighbour unless
``include_self`` is false, and fewer than k rows where there are fewer candidates. Rows without id and
vectors that are null or hold nulls, NaN or infinities take no part, neither as queries nor as points;
vectors of unequal length are an error; rows that repeat an id are candidates each, and as queries give
one list of neighbours together; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, matrix, round_half_up, sqdist, usable_rows
from ..storage import materialize
from .merge import top_k
from .twins import GRAIN, STRIP, apart, mirrored

#: Rows of a block of queries and of points that meet in one matrix product.
QUERY_BLOCK, POINT_BLOCK = 2048, 8192
#: Rows of a tile of the points' own distance matrix, tiles of a side of a cell at most.
TILE, TILES = 1024, 8
PAIRS = "query_id long, neighbor_id long, dist double"
METRICS = ("sqeuclidean", "euclidean")


def finish(table: DataFrame, metric: str, include_self: bool = True) -> DataFrame:
    """Distances of a squared-distance table in the metric asked for."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return table.withColumn("dist", F.sqrt("dist")) if metric == "euclidean" else table


def _check(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def nearest(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int, include_self: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, neighbour ids, squared distances), up to k a query, nearest first.

    Candidates come from |q|^2 + |p|^2 - 2 q.p; the few best are computed again as sums of squares, so
    cancellation neither reorders them nor makes a distance negative."""
    want = min(len(p_ids), k + 8 + (not include_self))
    rough = (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (q @ p.T)
    if want < len(p_ids):
        limit = np.partition(rough, want - 1, axis=1)[:, want - 1]
        scale = 1e-9 * ((q * q).sum(1) + (p * p).sum(1).max())
        row, at = np.nonzero(rough <= (limit + scale)[:, None])  # all that tie with the last stay
    else:
        row, at = np.divmod(np.arange(rough.size), max(1, len(p_ids)))
    if not include_self:
        other = q_ids[row] != p_ids[at]
        row, at = row[other], at[other]
    exact = np.empty(len(row))
    for i in range(0, len(row), 1 << 16):
        gap = q[row[i : i + (1 << 16)]] - p[at[i : i + (1 << 16)]]
        exact[i : i + (1 << 16)] = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((p_ids[at], exact, row))
    row, at, exact = row[order], at[order], exact[order]
    first = np.searchsorted(row, np.arange(len(q_ids)))
    keep = np.arange(len(row)) - first[row] < k
    return q_ids[row[keep]], p_ids[at[keep]], exact[keep]


def _batch(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["query_id", "neighbor_id", "dist"])


def blocks(df: DataFrame, rows: int, id_col: str, embedding: str) -> DataFrame:
    """df as packed blocks (ids, width, data) of at most ``rows`` rows."""
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "width", "data"])

    picked = usable_rows(df, id_col, embedding).select(F.col(id_col).cast("long").alias("id"), doubles(embedding).alias("e"))
    return picked.mapInArrow(pack, "ids binary, width int, data binary")


def _cells(q: DataFrame, p: DataFrame, queries: DataFrame, points: DataFrame) -> DataFrame:
    """Packed blocks of both sides (ids first) met in a grid of cells: each block of queries goes to every
    column of cells, each block of points to every row, so cells are tasks of equal work and no key
    gathers a side."""
    target = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, min(-(-points.count() // POINT_BLOCK), target))
    down = max(1, min(-(-queries.count() // QUERY_BLOCK), -(-target // across)))
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])
    q = q.withColumn("row", F.pmod(F.xxhash64("q_ids"), F.lit(down))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    p = p.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    return p.join(q, ["row", "column"])


#: Of the plans of pairs: points that a query meets in the first round for each of its k, and how many times
#: as many a round has met as the one before; rows of a side of a cell; components up to which each is a column.
FIRST, GROWTH, PAIR_ROWS, PLAIN_WIDTH = 16, 16, 4096, 128


def _spread(df: DataFrame, id_col: str, embedding: str, name: str, width: int, keep: tuple) -> DataFrame:
    """keep, id and vector of the usable rows; up to PLAIN_WIDTH components as a column each, so that a
    pair's distance is compiled arithmetic, not a function called for each component."""
    rows = usable_rows(df, id_col, embedding).select(*keep, F.col(id_col).alias(name), doubles(embedding).alias("_e"))
    if width > PLAIN_WIDTH:
        return rows.withColumnRenamed("_e", f"_{name}")
    at = [F.coalesce(F.col("_e")[i], F.lit(0.0)).alias(f"_{name}_{i}") for i in range(width)]
    return rows.select(*keep, name, *at)


def _spread_sqdist(width: int):
    """Squared distance of two _spread() rows, summed in the order of sqdist()."""
    if width > PLAIN_WIDTH:
        return sqdist("_query_id", "_neighbor_id")
    terms = [(F.col(f"_query_id_{i}") - F.col(f"_neighbor_id_{i}")) * (F.col(f"_query_id_{i}") - F.col(f"_neighbor_id_{i}")) for i in range(width)] or [F.lit(0.0)]
    return reduce(lambda a, b: a + b, terms)


def _sql_knn(queries: DataFrame, points: DataFrame, k: int, group: tuple[str, ...], id_col: str, embedding: str, include_self: bool) -> DataFrame:
    """Exact top-k by joins alone, a row a pair; with ``group`` only pairs of equal group, each pair once.

    Points are met in rounds of growing disjoint shares, dealt by a hash of their ids. A query's k-th
    distance so far bounds what can still enter, so every pair is tested, but only the few within the
    bound are sorted or shuffled; the last round has met all points."""
    both = [usable_rows(x, id_col, embedding).select(F.size(embedding).alias("n")) for x in (queries, points)]
    low, high = both[0].unionByName(both[1]).agg(F.min("n"), F.max("n")).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    width = low or 0
    spark = points.sparkSession
    n_q, n_p = queries.count(), points.count()
    most = (points.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) if group else n_p
    shares, size = [], FIRST * k
    while size * 2 < most:
        shares.append(size / most)
        size *= GROWTH
    shares.append(1.0)
    q, p = _spread(queries, id_col, embedding, "query_id", width, group), _spread(points, id_col, embedding, "neighbor_id", width, group)
    place = F.pmod(F.xxhash64("neighbor_id"), F.lit(1 << 30)) / float(1 << 30)
    target, result, before = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), None, 0.0
    for share in shares:
        asked = q if result is None else q.join(result.filter(F.col("rank") == k).select("query_id", F.col("dist").alias("_bound")), "query_id", "left")
        across = max(1, -(-int(n_p * (share - before)) // PAIR_ROWS)) if not group else 1
        down = max(1, -(-n_q // PAIR_ROWS), min(-(-target // across), -(-n_q // 64))) if not group else max(1, -(-most // PAIR_ROWS))
        # a row of the smaller side of the cells is copied to all cells that it meets
        asked = asked.withColumn("_row", F.pmod(F.xxhash64("query_id"), F.lit(down))).withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        met = p.filter((place >= before) & (place < share)) if share < 1.0 else p.filter(place >= before)
        met = met.withColumn("_column", F.pmod(F.xxhash64("neighbor_id", F.lit(7)), F.lit(across)).cast("int")).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
        keys, parts = [*group, "_row", "_column"], max(1, min(target, down * across if not group else target))
        pairs = asked.repartition(parts, *keys).hint("merge").join(met.repartition(parts, *keys), keys)
        if not include_self:
            pairs = pairs.filter("query_id <> neighbor_id")
        bound = [] if result is None else ["_bound"]
        pairs = pairs.select("query_id", "neighbor_id", _spread_sqdist(width).alias("dist"), *bound)
        if bound:
            pairs = pairs.filter(F.col("_bound").isNull() | (F.col("dist") <= F.col("_bound")))
        pairs = pairs.select("query_id", "neighbor_id", "dist")
        if result is not None:
            pairs = pairs.unionByName(result.select("query_id", "neighbor_id", "dist"))
        result = top_k(pairs.distinct() if group else pairs, k)
        before = share
        if share < 1.0:
            result = materialize(result, "nearest")
    return result


def exact_knn(queries: DataFrame, points: DataFrame, k: int, *, id_col: str = "id", embedding: str = "embedding", metric: str = "sqeuclidean", include_self: bool = True, engine: str = "blocks") -> DataFrame:
    """The k nearest points of every query, by testing all of them.

    `blocks` lets packed blocks of both sides meet, one matrix product each, and merges their top-k;
    `sql` is the same as declarative plans, a row a pair (_sql_knn), and the check of the other."""
    _check(k)
    if engine == "sql":
        return finish(_sql_knn(queries, points, k, (), id_col, embedding, include_self), metric)
    if engine != "blocks":
        raise ValueError("engine must be blocks or sql")
    pairs = _cells(blocks(queries, QUERY_BLOCK, id_col, embedding), blocks(points, POINT_BLOCK, id_col, embedding), queries, points)

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if r["width"] != r["q_width"]:
                    raise ValueError(f"vectors of {r['q_width']} and of {r['width']} components")
                p_ids, q_ids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                p, x = (np.frombuffer(r[c], np.float64).reshape(-1, r["width"]) for c in ("data", "q_data"))
                for at in range(0, len(q_ids), 256):
                    yield _batch(nearest(q_ids[at : at + 256], x[at : at + 256], p_ids, p, k, include_self))

    return finish(top_k(pairs.mapInArrow(meet, PAIRS), k), metric)


def exact_knn_chunked(queries: DataFrame, points: DataFrame, k: int, chunks: list, **options) -> DataFrame:
    """exact_knn over disjoint chunks of the points (filters on them), merged: what partitions, ranks
    or successive blocks of a large set compute."""
    tables = [exact_knn(queries, points.filter(c), k, **options) for c in chunks]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return top_k(out, k)


def distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q and p. Where cancellation would show, because a distance is
    small beside the norms or they are not finite, it is computed again as a sum of squares."""
    with np.errstate(over="ignore", invalid="ignore"):
        scale = (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :]
        out = scale - 2.0 * (q @ p.T)
        row, at = np.nonzero(~(out > 0.01 * scale))
    for i in range(0, len(row), 1 << 16):
        gap = q[row[i : i + (1 << 16)]] - p[at[i : i + (1 << 16)]]
        out[row[i : i + (1 << 16)], at[i : i + (1 << 16)]] = np.einsum("ij,ij->i", gap, gap)
    return out


def pairwise_sqdist(queries: DataFrame, points: DataFrame, id_col: str = "id", embedding: str = "embedding", digits: int | None = None) -> DataFrame:
    """(i, j, dist): the whole distance matrix, which is the result asked for, a cell of blocks a task;
    ``digits`` rounds the distances. Where both sides are the same frame, one triangle is computed."""
    if queries is points:
        return _own_sqdist(points, id_col, embedding, digits)
    pairs = _cells(blocks(queries, QUERY_BLOCK, id_col, embedding), blocks(points, POINT_BLOCK, id_col, embedding), queries, points)

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                p_ids, q_ids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                p, x = (np.frombuffer(r[c], np.float64).reshape(len(ids), -1) for c, ids in (("data", p_ids), ("q_data", q_ids)))
                if p.shape[1] != x.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and of {p.shape[1]} components")
                for a in range(0, len(q_ids), 32):
                    d = distances(x[a : a + 32], p).ravel()
                    d = d if digits is None else round_half_up(d, digits)
                    own = q_ids[a : a + 32]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(p_ids))), pa.array(np.tile(p_ids, len(own))), pa.array(d)], ["i", "j", "dist"])

    return pairs.mapInArrow(meet, "i long, j long, dist double")


def _own_sqdist(points: DataFrame, id_col: str, embedding: str, digits: int | None) -> DataFrame:
    """pairwise_sqdist of points with themselves. Rows are dealt to tiles by a hash of id and vector, so that
    both sides have the same tiles, and squares of tiles of one triangle are the tasks' cells; a distance
    and its mirror image are written near each other (twins.py)."""
    rows = usable_rows(points, id_col, embedding).select(F.col(id_col).cast("long").alias("id"), doubles(embedding).alias("e"))
    target = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-rows.count() // TILE))
    side = max(1, min(TILES, math.isqrt(tiles * tiles // min(GRAIN, target))))
    packed = rows.groupBy(F.pmod(F.xxhash64("id", "e"), F.lit(tiles)).alias("at")).agg(F.collect_list(F.struct("id", "e")).alias("rows"))
    own, last = F.floor(F.col("at") / side), (tiles - 1) // side
    keys, parts = ["cell_i", "cell_j"], apart(target, tiles * tiles // side**2)
    i = packed.select(F.col("at").alias("at_i"), F.col("rows").alias("rows_i"), own.alias("cell_i"), F.explode(F.sequence(own, F.lit(last).cast("long"))).alias("cell_j"))
    j = packed.select(F.col("at").alias("at_j"), F.col("rows").alias("rows_j"), own.alias("cell_j"), F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("cell_i"))
    met = i.repartition(parts, *keys).join(j.repartition(parts, *keys), keys).filter("at_i <= at_j")

    def meet(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                (i, x), (j, y) = ((ids, matrix(e)) for ids, e in (batch.column(c)[n].values.flatten() for c in ("rows_i", "rows_j")))
                if x.shape[1] != y.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and of {y.shape[1]} components")
                same = batch.column("at_i")[n].as_py() == batch.column("at_j")[n].as_py()
                if same:  # the other side's rows may lie in another order
                    j, y = i, x
                for at in range(0, len(i), STRIP):
                    d = distances(x[at : at + STRIP], y)
                    d = d if digits is None else round_half_up(d, digits)
                    ids, place = mirrored(i.slice(at, len(d)), j, np.ones(d.shape, bool), at if same else None)
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(d.ravel()[place])], ["i", "j", "dist"])

    return met.select("at_i", "at_j", "rows_i", "rows_j").mapInArrow(meet, "i long, j long, dist double")


def sparse_rows(points: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, cols, vals) a row of sparse points (id, col, val), by column; ids (id) adds the rows without
    entries. Entries without id, column or a finite value take no part."""
    kept = points.filter(F.col("id").isNotNull() & F.col("col").isNotNull() & ~F.isnan(F.col("val").cast("double")) & (F.abs(F.col("val").cast("double")) < float("inf")))
    held = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")))).alias("e"))
    held = held.select(F.col("id").cast("long").alias("id"), F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))
    if ids is None:
        return held
    rest = ids.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct().join(held.select("id"), "id", "left_anti")
    return held.unionByName(rest.select("id", F.array().cast("array<bigint>").alias("cols"), F.array().cast("array<double>").alias("vals")))


class Entries:
    """Rows of a sparse matrix in memory: row and column of every entry, values, squared norms."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.n, self.row, self.col, self.val = len(sizes), np.repeat(np.arange(len(sizes)), sizes), cols, vals
        self.norm = np.bincount(self.row, vals * vals, self.n)

    @classmethod
    def of(cls, cols, vals) -> Entries:
        """From two list columns."""
        cols, vals = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (cols, vals))
        return cls(np.diff(np.asarray(cols.offsets)), *(c.flatten().to_numpy(zero_copy_only=False) for c in (cols, vals)))

    def part(self, a: int, b: int) -> Entries:
        low, high = np.searchsorted(self.row, (a, b))
        return Entries(np.bincount(self.row[low:high] - a, minlength=b - a), self.col[low:high], self.val[low:high])


#: Columns of a dense piece, products of a sparse one, of a sparse matrix product in memory.
COLUMNS, PRODUCTS = 1024, 1 << 21


def sparse_dots(a: Entries, b: Entries) -> np.ndarray:
    """All inner products of the rows of a and b. Columns that many rows of both have go through dense
    pieces and matrix products; of the others only the products that occur are summed."""
    out = np.zeros((a.n, b.n))
    common = np.intersect1d(a.col, b.col)
    if not len(common):
        return out
    sides = []
    for m in (a, b):
        at = np.minimum(np.searchsorted(common, m.col), len(common) - 1)
        held = common[at] == m.col
        sides.append((m.row[held], at[held], m.val[held]))
    (ra, ca, va), (rb, cb, vb) = sides
    na, nb = np.bincount(ca, minlength=len(common)), np.bincount(cb, minlength=len(common))
    heavy = na * nb * 128 > a.n * b.n
    for c, v in ((ca, va), (cb, vb)):
        heavy[c[~np.isfinite(v)]] = False  # these meet nothing but the entries of their columns
    number = np.cumsum(heavy) - 1
    for first in range(0, int(heavy.sum()), COLUMNS):
        dense = []
        for m, r, c, v in ((a, ra, ca, va), (b, rb, cb, vb)):
            own = heavy[c] & (number[c] >= first) & (number[c] < first + COLUMNS)
            width = min(COLUMNS, int(heavy.sum()) - first)
            dense.append(np.bincount(r[own] * width + number[c[own]] - first, v[own], m.n * width).reshape(m.n, width))
        out += dense[0] @ dense[1].T
    light = ~heavy[ca]
    ra, ca, va = ra[light], ca[light], va[light]
    if len(ra):
        order = np.argsort(cb, kind="stable")
        rb, vb = rb[order], vb[order]
        begin, size = (np.cumsum(nb) - nb)[ca], nb[ca]
        cuts = np.searchsorted(np.cumsum(size), np.arange(PRODUCTS, size.sum() + PRODUCTS, PRODUCTS))
        low = 0
        for high in np.unique(np.append(cuts + 1, len(ra))).clip(max=len(ra)):
            n = size[low:high]
            entry = np.repeat(np.arange(low, high), n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[low:high], n)
            out += np.bincount(ra[entry] * b.n + rb[other], va[entry] * vb[other], a.n * b.n).reshape(a.n, b.n)
            low = high
    return out


def nearest_sparse(q_ids: np.ndarray, q: Entries, p_ids: np.ndarray, p: Entries, k: int, include_self: bool = True):
    """nearest() for sparse rows; the distance of a row to itself is 0."""
    dist = np.maximum(q.norm[:, None] + p.norm[None, :] - 2.0 * sparse_dots(q, p), 0.0)
    same = q_ids[:, None] == p_ids[None, :]
    dist[same] = 0.0 if include_self else np.inf
    want = min(len(p_ids), k)
    limit = np.partition(dist, want - 1, axis=1)[:, want - 1] if want else np.zeros(len(q_ids))
    row, at = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    exact = dist[row, at]
    order = np.lexsort((p_ids[at], exact, row))
    row, at, exact = row[order], at[order], exact[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q_ids)))[row] < k
    return q_ids[row[keep]], p_ids[at[keep]], exact[keep]


def sparse_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(id, cols, vals) as packed blocks (ids, sizes, cols, vals) of at most ``size`` rows."""
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                cols, vals = part.column("cols"), part.column("vals")
                cells = [part.column("id").to_numpy(), np.diff(np.asarray(cols.offsets)).astype(np.int64), cols.flatten().to_numpy(), vals.flatten().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["ids", "sizes", "cols", "vals"])

    return rows.mapInArrow(pack, "ids binary, sizes binary, cols binary, vals binary")


def exact_knn_sparse(queries: DataFrame, points: DataFrame, k: int, *, query_ids: DataFrame | None = None, point_ids: DataFrame | None = None, metric: str = "sqeuclidean", include_self: bool = True) -> DataFrame:
    """The k nearest of sparse rows (id, col, val); query_ids and point_ids (id) add rows without entries.

    Packed blocks of rows meet in the grid of exact_knn(), so a column that very many rows have is no
    hot key, and a cell gives out k rows a query."""
    _check(k)
    q, p = sparse_rows(queries, query_ids), sparse_rows(points, point_ids)
    pairs = _cells(sparse_blocks(q, QUERY_BLOCK), sparse_blocks(p, QUERY_BLOCK), q, p)

    def unpack(r, prefix=""):
        ids, sizes, cols = (np.frombuffer(r[prefix + c], np.int64) for c in ("ids", "sizes", "cols"))
        return ids, Entries(sizes, cols, np.frombuffer(r[prefix + "vals"], np.float64))

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("row", "column")}
                (p_ids, p), (q_ids, q) = unpack(r), unpack(r, "q_")
                for at in range(0, len(q_ids), 512):
                    yield _batch(nearest_sparse(q_ids[at : at + 512], q.part(at, min(at + 512, len(q_ids))), p_ids, p, k, include_self))

    return finish(top_k(pairs.mapInArrow(meet, PAIRS), k), metric)


def exact_knn_sparse_chunked(queries: DataFrame, points: DataFrame, k: int, chunks: list, *, metric: str = "sqeuclidean", **options) -> DataFrame:
    """exact_knn_sparse over disjoint chunks of the points (filters on them), merged."""
    tables = [exact_knn_sparse(queries, points.filter(c), k, **options) for c in chunks]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return finish(top_k(out, k), metric)


def leaf_pairs(members: DataFrame, k: int, group: tuple[str, ...] = ("leaf_id",), include_self: bool = True) -> DataFrame:
    """(query_id, neighbor_id, dist): each row's k nearest within its leaf; members (group, id, embedding).
    A leaf, bounded by the tree's leaf size, is one task's matrix product."""
    def search(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = matrix(table.column("embedding"))
        parts = [nearest(ids[a : a + 512], x[a : a + 512], ids, x, k, include_self) for a in range(0, len(ids), 512)]
        return pa.Table.from_batches([_batch(p) for p in parts])

    rows = usable_rows(members).select(*group, F.col("id").cast("long").alias("id"), "embedding")
    return rows.groupBy(*group).applyInArrow(search, PAIRS)


def leaf_knn(members: DataFrame, k: int, *, group: tuple[str, ...] = ("leaf_id",), metric: str = "sqeuclidean", include_self: bool = True, engine: str = "arrow") -> DataFrame:
    """Nearest neighbours within leaves. `sql` joins the members of a leaf in declarative plans (_sql_knn)."""
    _check(k)
    if engine == "sql":
        return finish(_sql_knn(members, members, k, group, "id", "embedding", include_self), metric)
    return finish(top_k(leaf_pairs(members, k, group, include_self), k), metric)


def leaf_knn_queries(queries: DataFrame, members: DataFrame, k: int, *, metric: str = "sqeuclidean") -> DataFrame:
    """Nearest members of the leaf that each query was sent to; both (leaf_id, id, embedding)."""
    _check(k)

    def search(q: pa.Table, p: pa.Table) -> pa.Table:
        q_ids, p_ids = (t.column("id").to_numpy() for t in (q, p))
        if not len(q_ids) or not len(p_ids):
            return pa.Table.from_batches([_batch((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))])
        x, y = matrix(q.column("embedding")), matrix(p.column("embedding"))
        return pa.Table.from_batches([_batch(nearest(q_ids[a : a + 512], x[a : a + 512], p_ids, y, k)) for a in range(0, len(q_ids), 512)])

    def side(df: DataFrame):
        return usable_rows(df).select("leaf_id", F.col("id").cast("long").alias("id"), "embedding").groupBy("leaf_id")

    return finish(top_k(side(queries).cogroup(side(members)).applyInArrow(search, PAIRS), k), metric)


def leaf_knn_overlap(ordered: DataFrame, k: int, overlap: int, *, metric: str = "sqeuclidean") -> DataFrame:
    """Neighbours within a leaf widened by ``overlap`` rows on either side in tree order; ordered
    (pos, leaf_id, id, embedding).

    The range join is an equi-join on buckets of positions as wide as the widest window; a leaf's
    window touches two or three buckets. Its blocks of queries and of points meet as matrix products."""
    _check(k)
    ordered = usable_rows(ordered)
    windows = ordered.groupBy("leaf_id").agg((F.min("pos") - overlap).alias("low"), (F.max("pos") + overlap).alias("high"))
    width = windows.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    wanted = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    p = ordered.select("pos", F.col("id").cast("long").alias("id"), doubles("embedding").alias("embedding"), F.floor(F.col("pos") / width).alias("bucket"))
    reach = p.join(wanted, "bucket").filter("pos BETWEEN low AND high")
    reach = reach.select(F.col("leaf_id").cast("long").alias("leaf_id"), F.floor(F.col("pos") / POINT_BLOCK).alias("chunk"), "id", "embedding")

    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table.column("embedding"))
        cells = [table.column("leaf_id")[:1], table.column("chunk")[:1], pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())]
        return pa.table(cells, ["leaf_id", "chunk", "ids", "width", "data"])

    def packed(df: DataFrame) -> DataFrame:
        return df.groupBy("leaf_id", "chunk").applyInArrow(pack, "leaf_id long, chunk long, ids binary, width int, data binary")

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if r["width"] != r["q_width"]:
                    raise ValueError(f"vectors of {r['q_width']} and of {r['width']} components")
                p_ids, q_ids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                p, x = (np.frombuffer(r[c], np.float64).reshape(len(ids), -1) for c, ids in (("data", p_ids), ("q_data", q_ids)))
                for at in range(0, len(q_ids), 256):
                    yield _batch(nearest(q_ids[at : at + 256], x[at : at + 256], p_ids, p, k))

    # a leaf's blocks of queries are cells of their own, to which its blocks of points are copied
    q = packed(ordered.select(F.col("leaf_id").cast("long").alias("leaf_id"), F.floor(F.col("pos") / QUERY_BLOCK).alias("chunk"), F.col("id").cast("long").alias("id"), doubles("embedding").alias("embedding")))
    q = q.select("leaf_id", F.col("chunk").alias("cell"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "data")])
    cells = windows.select(F.col("leaf_id").cast("long").alias("leaf_id"), F.explode(F.sequence(F.floor((F.col("low") + overlap) / QUERY_BLOCK), F.floor((F.col("high") - overlap) / QUERY_BLOCK))).alias("cell"))
    p = packed(reach).join(cells, "leaf_id").drop("chunk")
    pairs = p.join(q, ["leaf_id", "cell"]).drop("leaf_id", "cell")
    return finish(top_k(pairs.mapInArrow(meet, PAIRS), k), metric)


def leaf_knn_sparse(points: DataFrame, leaves: DataFrame, k: int, *, group: tuple[str, ...] = ("leaf_id",), metric: str = "sqeuclidean", include_self: bool = True) -> DataFrame:
    """leaf_knn for sparse points (id, col, val) and leaves (group, id), rows without entries included:
    a leaf's rows meet in one task, which multiplies them there and gives out k rows a point."""
    _check(k)

    def search(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), Entries.of(table.column("cols"), table.column("vals"))
        parts = [nearest_sparse(ids[a : a + 512], x.part(a, min(a + 512, len(ids))), ids, x, k, include_self) for a in range(0, len(ids), 512)]
        return pa.Table.from_batches([_batch(p) for p in parts])

    members = leaves.select(*group, F.col("id").cast("long").alias("id")).join(sparse_rows(points), "id", "left")
    members = members.select(*group, "id", F.coalesce("cols", F.array().cast("array<bigint>")).alias("cols"), F.coalesce("vals", F.array().cast("array<double>")).alias("vals"))
    pairs = members.groupBy(*group).applyInArrow(search, PAIRS)
    if len(group) > 1:
        pairs = pairs.groupBy("query_id", "neighbor_id").agg(F.min("dist").alias("dist"))
    return finish(top_k(pairs, k), metric)


def local_exact(queries: DataFrame, points: DataFrame, k: int, part, **options) -> DataFrame:
    """exact_knn on one part of the points, given by a condition."""
    return exact_knn(queries, points.filter(part), k, **options)


