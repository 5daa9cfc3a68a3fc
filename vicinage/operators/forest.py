"""All-nearest-neighbour graphs from a forest of median-split trees.

A tree projects all rows, halves them level by level into leaves and searches each leaf exhaustively;
the trees' candidates are merged into a running top-k until the wanted recall or number of trees is
reached. Each tree's directions depend on the seed and its number alone, so results are repeatable.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix, usable_rows
from ..storage import materialize
from . import metrics, search
from .directions import make_directions
from .exchange import sample_rows
from .merge import merge_neighbors, top_k
from .monitor import Profiler, Recorder, SearchError
from .tree import NODE_ROWS, assign_leaves, bin_queries, local_leaves, node_medians, project_blocks, project_dense, project_sparse, tree_levels

#: Rows of a node up to which one task splits it further and searches its leaves.
FUSED_ROWS = 50_000


class Forest:
    """A forest over dense points (id, embedding) or sparse ones (id, col, val).

    levels: depth of the trees; by default as many as leaves of ``leafsize`` rows need, and 0 means
    one leaf, an exact search. ids (id) lists the rows of sparse points that may have no entries.
    directions(tree) -> matrix (levels, width) replaces the drawn ones.
    Rows without id and vectors that are null or hold nulls, NaN or infinities take no part; rows that
    repeat an id are in the trees each and one entry in the graph; no points at all are an error."""

    def __init__(self, points: DataFrame, *, leafsize: int = 512, levels: int | None = None, seed: int = 0, kind: str = "gaussian_qr", width: int | None = None, ids: DataFrame | None = None, directions: Callable[[int], np.ndarray] | None = None, fused_rows: int = FUSED_ROWS, node_rows: int = NODE_ROWS):
        self.sparse = {"col", "val"} <= set(points.columns)
        if not self.sparse and "embedding" not in points.columns:
            raise SearchError("points need (id, embedding) or (id, col, val)")
        self.points = points.select("id", "col", "val") if self.sparse else usable_rows(points).select(F.col("id").cast("long").alias("id"), "embedding")
        self.ids = (ids if ids is not None else points).select("id").filter("id IS NOT NULL").distinct() if self.sparse else self.points.select("id")
        self.n = self.ids.count()
        if self.n == 0:
            raise SearchError("no points")
        self.levels = tree_levels(self.n, leafsize) if levels is None else levels
        if self.levels < 0 or 2**self.levels > self.n:
            raise SearchError(f"{self.levels} levels need at least {2**max(self.levels, 0)} points, not {self.n}")
        if width is None:
            row = points.agg(F.max("col")).first() if self.sparse else points.agg(F.max(F.size("embedding"))).first()
            width = (row[0] or 0) + 1 if self.sparse else row[0]
        self.width, self.seed, self.kind, self.given = width, seed, kind, directions
        self.fused_rows, self.node_rows = fused_rows, node_rows
        self.recorder, self.profiler = Recorder(), Profiler()

    def __str__(self) -> str:
        return f"{'sparse' if self.sparse else 'dense'} forest: {self.n} points of width {self.width}, {self.levels} levels, {2**self.levels} leaves of about {self.n / 2**self.levels:.0f} rows, seed {self.seed}"

    def directions(self, tree: int) -> np.ndarray:
        if self.given is not None:
            return np.asarray(self.given(tree))[: self.levels]
        return make_directions(self.width, self.levels, self.seed * 1_000_003 + tree, self.kind)

    def projected(self, tree: int) -> DataFrame:
        """(id, proj) of all points."""
        d = self.directions(tree)
        return project_sparse(self.points, d, self.ids) if self.sparse else project_dense(self.points, d)

    def leaves(self, trees: list[int], levels: int | None = None) -> DataFrame:
        """(tree, id, leaf_id) of several trees, whose levels are split together; with ``levels`` the
        nodes of that depth."""
        levels = self.levels if levels is None else levels
        if self.sparse:
            rows = None
            for t in trees:
                own = self.projected(t).select(F.lit(t).alias("tree"), "id", "proj")
                rows = own if rows is None else rows.unionByName(own)
        else:
            rows = project_blocks(self.points, {t: self.directions(t)[:levels] for t in trees})
        return assign_leaves(rows, levels, ("tree",), self.node_rows)

    def candidates(self, trees: list[int], k: int, include_self: bool = True) -> DataFrame:
        """(query_id, neighbor_id, dist): the k nearest of each point within its leaf of each tree.

        Dense trees are split level by level until a node fits a task (``fused_rows``); there the rest
        of its levels are split and its leaves searched where its rows meet, after one shuffle."""
        if self.sparse:
            return search.leaf_knn_sparse(self.points, self.leaves(trees), k, group=("tree", "leaf_id"), include_self=include_self).drop("rank")
        top = 0
        while top < self.levels and self.n / 2**top > self.fused_rows:
            top += 1
        if top:
            members = self.leaves(trees, top).join(self.points, "id")
        else:  # a partition a tree: hashing a few tree numbers would put several trees into one task
            members = self.points.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in trees]))).withColumn("leaf_id", F.lit(0).cast("long"))
            members = members.repartitionByRange(len(trees), "tree") if len(trees) > 1 else members
        directions, levels = {t: self.directions(t)[top:] for t in trees}, self.levels - top

        def grow(table: pa.Table) -> pa.Table:
            ids, x = table.column("id").to_numpy(), matrix(table.column("embedding"))
            leaf = local_leaves(x @ directions[table.column("tree")[0].as_py()].T, ids, levels)
            order = np.argsort(leaf, kind="stable")
            parts = []
            for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                parts += [search.nearest(ids[rows[a : a + 512]], x[rows[a : a + 512]], ids[rows], x[rows], k, include_self) for a in range(0, len(rows), 512)]
            return pa.table({name: np.concatenate(c) for name, c in zip(("query_id", "neighbor_id", "dist"), zip(*parts))})

        return members.select("tree", "leaf_id", "id", "embedding").groupBy("tree", "leaf_id").applyInArrow(grow, search.PAIRS)

    def _recall(self, truth: DataFrame, found: DataFrame) -> float:
        return metrics.recall_distance(truth, found, 1e-9).first()[0]

    def all_search(self, k: int, ntrees: int = 5, *, truth: DataFrame | None = None, threshold: float = 0.95, monitor: Callable[[int, DataFrame], bool] | None = None, previous: DataFrame | None = None, batch: int = 1, metric: str = "sqeuclidean", include_self: bool = True) -> DataFrame:
        """The graph from up to ``ntrees`` trees, ``batch`` of them a round.

        After each round the running result is written (which cuts the lineage); with ``truth`` (of any
        subset of the points) the search stops at a recall above ``threshold``, and with ``monitor``
        (number of trees, result) once it returns true. ``previous`` is a squared-distance result
        that these trees refine."""
        if k < 1 or ntrees < 1 or batch < 1:
            raise SearchError("k, ntrees and batch must be at least 1")
        result = previous
        for first in range(0, ntrees, batch):
            trees = list(range(first, min(first + batch, ntrees)))
            with self.profiler.region("trees"):
                pairs = self.candidates(trees, k, include_self)
                tables = [pairs] if result is None else [pairs, result]
                result = materialize(merge_neighbors(*tables, k=k), "graph")
            if truth is not None:
                with self.profiler.region("recall"):
                    recall = self._recall(truth, result)
                self.recorder.push("recall", recall)
                if recall > threshold:
                    break
            if monitor is not None and monitor(trees[-1] + 1, result):
                break
        return search.finish(result, metric)

    def refine(self, previous: DataFrame, k: int, trees: list[int]) -> DataFrame:
        """A squared-distance result improved by further trees."""
        return merge_neighbors(previous, self.candidates(trees, k), k=k)

    def overlap_search(self, k: int, ntrees: int = 5, *, workers: int = 4, metric: str = "sqeuclidean") -> DataFrame:
        """The graph from ``ntrees`` trees whose jobs run side by side; no early stop."""
        if k < 1 or ntrees < 1:
            raise SearchError("k and ntrees must be at least 1")
        with ThreadPoolExecutor(workers) as pool:
            tables = list(pool.map(lambda t: materialize(merge_neighbors(self.candidates([t], k), k=k), "tree"), range(ntrees)))
        return search.finish(merge_neighbors(*tables, k=k), metric)

    def query_search(self, queries: DataFrame, k: int = 16, ntrees: int = 5, *, metric: str = "sqeuclidean") -> DataFrame:
        """The k nearest points found for other rows (id, embedding): each is routed down every tree by
        the nodes' medians and searched in the leaf it comes to."""
        if self.sparse:
            raise SearchError("queries are routed through dense forests only")
        asked = usable_rows(queries).select(F.col("id").cast("long").alias("id"), "embedding")
        tables = []
        for t in range(ntrees):
            projected, directions = self.projected(t), self.directions(t)
            leaves = materialize(assign_leaves(projected, self.levels, (), self.node_rows), "leaves")
            medians = materialize(node_medians(projected, leaves, self.levels), "medians")  # read once a level
            bins = bin_queries(project_dense(asked, directions), medians, self.levels)
            tables.append(search.leaf_knn_queries(bins.join(asked, "id"), leaves.join(self.points, "id"), k))
        return search.finish(merge_neighbors(*tables, k=k), metric)

    def exact(self, queries: DataFrame, k: int, *, metric: str = "sqeuclidean") -> DataFrame:
        """The true neighbours of queries of the same kind as the points."""
        if self.sparse:
            return search.exact_knn_sparse(queries, self.points, k, query_ids=queries.select("id").distinct(), point_ids=self.ids, metric=metric)
        return search.exact_knn(queries, self.points, k, metric=metric)

    def search(self, k: int, ntrees: int = 5, *, sample: int = 100, k_list: list[int] | None = None, threshold: float = 0.95, batch: int = 1, metric: str = "sqeuclidean") -> tuple[DataFrame, DataFrame]:
        """(graph, recall at several k): the truth of a sample of points is searched exactly, the forest
        grows until its recall passes the threshold, and the sample's recall is reported."""
        picked = sample_rows(self.ids, sample, seed=self.seed)
        queries = self.points.join(F.broadcast(picked), "id")
        truth = materialize(self.exact(queries, k), "truth")
        graph = self.all_search(k, ntrees, truth=truth, threshold=threshold, batch=batch)
        found = graph.join(F.broadcast(picked.withColumnRenamed("id", "query_id")), "query_id")
        return search.finish(graph, metric), metrics.recall_at_k(truth, found, k_list, 1e-9)


def forest_knn(points: DataFrame, k: int, ntrees: int = 5, **options) -> DataFrame:
    """The graph of one call, all trees in one plan."""
    forest = Forest(points, **options)
    return top_k(merge_neighbors(forest.candidates(list(range(ntrees)), k), k=k), k)
