"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string of bits, the sides of random hyperplanes, and keeps the
strings of a shard of rows in a sorted array. A query descends every tree to its longest matching
prefix; the trees then ascend together, one bit shorter at a time, until the rows under the matched
prefixes are enough candidates, which are scored exactly. How many are enough is measured for each
shard: the fewest at which a sample of its queries gets back the wanted share of their true neighbours
in the shard. Inner products become angles by one more dimension that gives every row of a shard the
same length. Shards are bounded, so the trees are too; every shard answers every query and the best
answers are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .topk import align, matrix, ranked, vectors, waves

#: Trees of a forest, bits of a string, rows of a shard at most.
TREES, BITS, SHARD = 64, 24, 1 << 15
#: Queries that a forest answers once it is built; more go out in further rounds.
QUERIES = 1 << 14
#: Recall that the sample must reach, queries of the sample (bounded, whatever the number of queries), and
#: matches a wanted neighbour, counted in all trees, at which the ascent stops at the earliest.
RECALL, SAMPLE, FEWEST = 0.97, 64, 50


class Forest:
    """A forest over one shard: sorted arrays of strings and their rows, a tree each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.ids, self.x, self.trees, self.bits = ids, x, trees, bits
        longest = float(np.sqrt((x * x).sum(1).max(initial=0.0)))
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits)).astype(np.float32)
        scaled = x / (longest or 1.0)
        lift = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1, keepdims=True)))
        codes = self.strings(np.hstack([scaled, lift]))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings as integers, the first bit the highest."""
        out = np.empty((self.trees, len(rows)), np.uint32)
        weight = (np.uint32(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint32)).astype(np.float64)
        for at in range(0, len(rows), 1024):
            side = (rows[at : at + 1024].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[:, at : at + 1024] = (side @ weight).T.astype(np.uint32)
        return out

    def candidates(self, q: np.ndarray, enough: int):
        """For each query the rows under the matched prefixes of all trees at the first level of the
        common ascent where the trees' matches come to ``enough``."""
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        codes = self.strings(np.hstack([q / np.where(norm == 0, 1, norm), np.zeros((len(q), 1))]))
        low = np.zeros((self.trees, len(q)), np.int64)
        high = np.full((self.trees, len(q)), len(self.ids), np.int64)
        waiting = np.arange(len(q))
        for level in range(self.bits, -1, -1):
            if not len(waiting):
                break
            shift = np.uint64(self.bits - level)
            prefix = (codes[:, waiting].astype(np.uint64) >> shift) << shift
            end = prefix + (np.uint64(1) << shift)
            for t in range(self.trees):
                low[t, waiting] = np.searchsorted(self.sorted[t], prefix[t])
                high[t, waiting] = np.searchsorted(self.sorted[t], end[t])
            waiting = waiting[(high[:, waiting] - low[:, waiting]).sum(0) < enough]
        seen = np.zeros(len(self.ids), bool)
        for i in range(len(q)):
            for t in range(self.trees):
                seen[self.order[t, low[t, i] : high[t, i]]] = True
            rows = np.flatnonzero(seen)
            seen[rows] = False
            yield rows

    def enough(self, query_ids: np.ndarray, q: np.ndarray, k: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
        """Matches at which the ascent may stop: doubled until queries spread over all of them find
        ``recall`` of their k nearest rows of the shard."""
        picked = np.unique(np.linspace(0, len(q) - 1, min(sample, len(q))).astype(int))
        score = self.x @ q[picked].T
        score[self.ids[:, None] == query_ids[picked][None, :]] = -np.inf
        wanted = min(k, len(self.ids))
        true = np.argpartition(-score, wanted - 1, axis=0)[:wanted].T
        matches = FEWEST * k
        while matches < self.trees * len(self.ids):
            found = [np.isin(t, rows, assume_unique=True).mean() for t, rows in zip(true, self.candidates(q[picked], matches))]
            if np.mean(found) >= recall:
                break
            matches *= 2
        return matches

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, enough: int):
        """(query_id, vec_id, score) arrays of each query's k best candidates other than itself."""
        sizes = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        for query, vector, rows in zip(query_ids, q, self.candidates(q, enough)):
            rows = rows[self.ids[rows] != query]
            if len(rows) > k:  # a product of matrices rounds equal rows differently; what it may hide stays
                rough = self.x[rows] @ vector
                limit = np.partition(rough, len(rough) - k)[len(rough) - k]
                rows = rows[rough >= limit - 1e-9 * (np.linalg.norm(vector) * sizes[rows] + abs(limit))]
            score = scores(self.x[rows], vector)
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield query, self.ids[rows[best]], score[best]


def scores(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of the components, so equal rows get equal scores
    wherever they are."""
    out = np.zeros(len(x))
    for j, v in enumerate(vector):
        out += x[:, j] * v
    return out


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, *, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """The k nearest rows found for every query by inner product: (query_id, rank, vec_id, score).

    Every usable row is indexed. Vectors that are null, zero or hold nulls or non-finite components,
    and rows without vec_id, take no part; vectors of unequal length are compared as if padded with
    zeros; a row with the query's own vec_id is no answer; a repeated query id is asked once; of
    equal scores the smaller vec_id comes first; repeated candidate rows are candidates each; empty
    tables give no rows; other columns are ignored."""
    spark = candidates.sparkSession
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors(candidates, vec_id, embedding).filter(nonzero)
    result = None
    for ids, q in waves(vectors(queries, vec_id, embedding).filter(nonzero), QUERIES):
        sent = spark.sparkContext.broadcast((ids, q))

        def search(batches, sent=sent):
            query_ids, q = sent.value

            def answer(held):
                own = np.concatenate([b.column("vec_id").to_numpy() for b in held])
                x, asked = align(matrix(pa.chunked_array([b.column("embedding") for b in held])), q)
                forest = Forest(own, x, trees, bits)
                found = list(forest.search(query_ids, asked, k, forest.enough(query_ids, asked, k, recall)))
                sizes = [len(i) for _, i, _ in found]
                cells = [np.repeat(query_ids, sizes), np.concatenate([i for _, i, _ in found]), np.concatenate([s for _, _, s in found])]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "vec_id", "score"])

            held, n = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, SHARD):
                    part = batch.slice(at, SHARD)
                    if n and n + part.num_rows > SHARD:
                        yield answer(held)
                        held, n = [], 0
                    held.append(part)
                    n += part.num_rows
            if n:
                yield answer(held)

        found = materialize(ranked(rows.mapInArrow(search, "query_id long, vec_id long, score double"), k), "nearest")
        result = found if result is None else result.unionByName(found)
    return result if result is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op7_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.filter("vec_id % 20 = 0"), 20)
