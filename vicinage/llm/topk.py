"""Exact top-k inner products in three phases with a uniform threshold.

A vector's dimensions are split into ``lists`` score lists, and a score is the sum of its partial
scores. Phase 1 gathers the entries that lead each local list, with their full scores; the k-th best
full score seen is a cutoff that no answer lies below. Phase 2 sends the cutoff out: an entry of the
answer has a partial score of at least cutoff / lists in some list, so only such entries are
collected. Phase 3 resolves their full scores exactly. Queries go out in waves of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Queries sent to the executors at once, and candidates scored at once.
WAVE, BLOCK = 4096, 2048


def usable(embedding: Column) -> Column:
    """Not null, and every component not null and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))


def waves(queries: DataFrame, size: int = WAVE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ``size`` queries at a time; shorter vectors are padded with zeros.
    A query id that is repeated is asked once, with its smallest vector."""
    once = materialize(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    parts = max(1, -(-once.count() * 5 // (4 * size)))
    for k in range(parts):
        rows = once.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).toArrow()
        rows = rows.sort_by("vec_id")
        for at in range(0, rows.num_rows, size):
            part = rows.slice(at, size).combine_chunks()
            yield part.column("vec_id").to_numpy(), matrix(part.column("embedding"))


def matrix(column) -> np.ndarray:
    """A list column as a matrix, shorter rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.float64)
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the wider one's width, padded with zeros."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def floor_ints(x: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) as doubles that hold integers."""
    return np.floor(scale * x)


def partial_scores(q: np.ndarray, c: np.ndarray, lists: int) -> np.ndarray:
    """(lists, queries, candidates) integer partial scores; exact beyond 2**53 by Python integers."""
    q, c = align(q, c)
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    exact = q.size == 0 or c.size == 0 or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53
    if not exact:
        q, c = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (q, c))
    out = [q[:, a:b] @ c[:, a:b].T if b > a else np.zeros((len(q), len(c))) for a, b in zip(cuts, cuts[1:])]
    return np.stack([np.asarray(p, np.float64 if exact else object) for p in out])


def _saturate(scores) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], np.int64)
    return scores.astype(np.int64)


class Best:
    """The k best (score, smaller id) entries of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        if len(ids) > self.k:
            keep = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[keep], scores[keep]
        self.ids[q], self.scores[q] = ids, scores

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        counts = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*self.scores, self.scores[0][:0] if self.scores else np.zeros(0, np.int64)]))], ["query_id", "vec_id", "score"])


def ranked(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries a query, rank from 1: larger score, then smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, *, vec_id: str = "vec_id", embedding: str = "embedding", lists: int = 4, scale: int = 1024) -> DataFrame:
    """The k candidates of largest integer inner product for every query: (query_id, rank, vec_id, score).

    Components count as floor(scale * x). A candidate with the query's own vec_id is no answer.
    Vectors that are null or hold nulls or non-finite components, and rows without vec_id, take no
    part; vectors of unequal length are compared as if padded with zeros; repeated candidate rows
    are candidates each; a repeated query id is asked once; empty tables give no rows; scores
    beyond a long are held at its ends; other columns are ignored."""
    spark = candidates.sparkSession
    rows, asked = vectors(candidates, vec_id, embedding), vectors(queries, vec_id, embedding)
    result = None
    for ids, q in waves(asked):
        sent = spark.sparkContext.broadcast((ids, floor_ints(q, scale)))

        def scored(batches, sent=sent):
            ids, q = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    own = part.column("vec_id").to_numpy()
                    c = floor_ints(matrix(part.column("embedding")), scale)
                    for first in range(0, len(ids), 512):
                        yield first, ids[first : first + 512], own, partial_scores(q[first : first + 512], c, lists)

        def gather(batches):  # phase 1
            best = Best(len(sent.value[0]), k)
            for first, asked_ids, own, partial in scored(batches):
                total = partial.sum(0)
                lead = min(k + 1, len(own))  # one more: the query itself may lead
                top = np.argpartition(-partial.astype(np.float64), lead - 1, axis=2)[:, :, :lead]
                for i in range(len(asked_ids)):
                    entries = np.unique(top[:, i])
                    entries = entries[own[entries] != asked_ids[i]]
                    best.add(first + i, own[entries], _saturate(total[i, entries]))
            yield best.batch(sent.value[0])

        found = ranked(rows.mapInArrow(gather, "query_id long, vec_id long, score long"), k)
        cutoffs = dict(found.filter(F.col("rank") == k).select("query_id", "score").toPandas().itertuples(index=False))
        # A query without a cutoff has fewer than k candidates, which are all its answer.
        bounded = np.array([i in cutoffs for i in ids.tolist()], bool)
        floor = spark.sparkContext.broadcast((np.array([cutoffs.get(i, -(2**63)) for i in ids.tolist()], np.int64), bounded))

        def resolve(batches, floor=floor):  # phases 2 and 3
            best = Best(len(sent.value[0]), k)
            for first, asked_ids, own, partial in scored(batches):
                low, bound = (x[first : first + len(asked_ids), None] for x in floor.value)
                collected = (partial * lists >= low).any(0) | ~bound
                for i in np.flatnonzero(collected.any(1)):
                    entries = np.flatnonzero(collected[i])
                    total = _saturate(partial[:, i, entries].sum(0))
                    keep = (total >= low[i]) & (own[entries] != asked_ids[i])
                    if keep.any():
                        best.add(first + i, own[entries[keep]], total[keep])
            yield best.batch(sent.value[0])

        answer = materialize(ranked(rows.mapInArrow(resolve, "query_id long, vec_id long, score long"), k), "top-k")
        result = answer if result is None else result.unionByName(answer)
    return result if result is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(table, table.filter("vec_id % 100 = 0"), 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
