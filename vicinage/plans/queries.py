"""Registered queries on the driver's tables, and the SQL that must agree with them.

Directions are drawn once and written as literals into both sides; distances are rounded to six
digits in both. Dense points are `embeddings`; `sparse_emb` are its entries above 0.15 in size, and
`sparse_sp` the quantities of lineitem by supplier and part.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sparse, vectors
from ..operators import exchange, merge, metrics, search, tree, twins
from ..operators.directions import directions_frame, load_directions, make_directions, orthoproj, save_directions
from ..operators.forest import Forest
from ..sources import generators, readers, writers
from ..storage import fresh_path, local_path, materialize

K, LEVELS, TREES, WIDTH = 8, 3, 3, 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- inputs -------------------------------------------------------------------------------------


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def sparse_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.entries(dense(spark, sf_dir), "id", "embedding", 0.15)


def sparse_sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


@cache
def directions(t: int) -> np.ndarray:
    return make_directions(WIDTH, LEVELS, 1000 + t)


def small_forest(points: DataFrame, **options) -> Forest:
    return Forest(points, levels=LEVELS, width=WIDTH, directions=directions, **options)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("dist",):
        df = df.withColumn(c, F.round(c, 6))
    return df


# ---- SQL fragments ------------------------------------------------------------------------------

P = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
S = P + ", s AS (SELECT id, i - 1 AS col, e[i] AS val FROM p, range(1, 65) t(i) WHERE abs(e[i]) > 0.15)"
SP = "s AS (SELECT l_suppkey AS id, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2)"


def sqd(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def literal(v) -> str:
    return "[" + ", ".join(f"{float(x):.17e}" for x in v) + "]"


def proj(e: str, v) -> str:
    return f"list_sum(list_transform(list_zip({e}, {literal(v)}), lambda z: z[1] * z[2]))"


def ranked(pairs: str, k: int = K, dist: str = "dist") -> str:
    """SELECT of a neighbour table from rows (query_id, neighbor_id, dist)."""
    return f"SELECT query_id, rank, neighbor_id, round({dist}, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM ({pairs})) WHERE rank <= {k}"


EXACT = f"SELECT q.id AS query_id, r.id AS neighbor_id, {sqd('q.e', 'r.e')} AS dist FROM p q, p r"


def leaves_sql(t: int, name: str, points: str = "p", sparse_: bool = False) -> str:
    """CTEs ending in ``name`` (id, leaf_id) of tree t."""
    if sparse_:
        values = ", ".join(f"({l}, {c}, {float(w):.17e})" for l, row in enumerate(directions(t)) for c, w in enumerate(row))
        out = f"{name}_d AS (SELECT * FROM (VALUES {values}) AS v(level, col, weight)), {name}_l AS (SELECT s.id, d.level, sum(s.val * d.weight) AS proj FROM s JOIN {name}_d d ON s.col = d.col GROUP BY 1, 2), {name}_0 AS (SELECT p.id, 0 AS leaf_id, " + ", ".join(f"coalesce((SELECT l.proj FROM {name}_l l WHERE l.id = p.id AND l.level = {l}), 0) AS x{l}" for l in range(LEVELS)) + " FROM p)"
    else:
        out = f"{name}_0 AS (SELECT id, 0 AS leaf_id, " + ", ".join(f"{proj('e', d)} AS x{l}" for l, d in enumerate(directions(t))) + f" FROM {points})"
    for l in range(LEVELS):
        out += f", {name}_{l + 1} AS (SELECT id, CAST(leaf_id * 2 + CASE WHEN row_number() OVER (PARTITION BY leaf_id ORDER BY x{l}, id) > count(*) OVER (PARTITION BY leaf_id) // 2 THEN 1 ELSE 0 END AS BIGINT) AS leaf_id, {', '.join(f'x{m}' for m in range(LEVELS))} FROM {name}_{l})"
    return out + f", {name} AS (SELECT id, leaf_id, {', '.join(f'x{m}' for m in range(LEVELS))} FROM {name}_{LEVELS})"


def leaf_pairs_sql(name: str) -> str:
    return f"SELECT a.id AS query_id, b.id AS neighbor_id, {sqd('x.e', 'y.e')} AS dist FROM {name} a JOIN {name} b ON a.leaf_id = b.leaf_id JOIN p x ON x.id = a.id JOIN p y ON y.id = b.id"


def deduped(pairs: str) -> str:
    return f"SELECT query_id, neighbor_id, min(dist) AS dist FROM ({pairs}) GROUP BY 1, 2"


def topk_sql(pairs: str, k: int = K) -> str:
    return f"SELECT query_id, rank, neighbor_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM ({pairs})) WHERE rank <= {k}"


def forest_pairs(trees) -> str:
    return deduped(" UNION ALL ".join(topk_sql(leaf_pairs_sql(f"t{t}")) for t in trees))


def forest_ctes(trees) -> str:
    return ", ".join(leaves_sql(t, f"t{t}") for t in trees)


SPARSE_PAIRS = "n AS (SELECT id, sum(val * val) AS n2 FROM s GROUP BY 1), d AS (SELECT a.id AS i, b.id AS j, sum(a.val * b.val) AS dot FROM s a JOIN s b ON a.col = b.col GROUP BY 1, 2)"

# ---- rows and distances -------------------------------------------------------------------------


@query(f"WITH {P} {ranked(EXACT)}")
def exact_knn(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(search.exact_knn(points, points, K))


@query(f"WITH {P} {ranked(EXACT, dist='sqrt(dist)')}")
def exact_knn_euclidean(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(search.exact_knn(points, points, K, metric="euclidean"))


@query(f"WITH {P} {ranked(EXACT)}")
def exact_knn_sql(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(search.exact_knn(points, points, K, engine="sql"))


@query(f"WITH {P} {ranked(EXACT + ' WHERE q.id <> r.id')}")
def exact_knn_without_self(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(search.exact_knn(points, points, K, include_self=False))


@query(f"WITH {P} {ranked(EXACT)}")
def exact_knn_chunked(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(search.exact_knn_chunked(points, points, K, [F.col("id") % 3 == i for i in range(3)]))


@query(f"WITH {P} {ranked(EXACT + ' WHERE r.id % 4 = 1')}")
def local_exact(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(search.local_exact(points, points, K, F.col("id") % 4 == 1))


@query(f"WITH {SP}, {SPARSE_PAIRS} " + ranked("SELECT a.id AS query_id, b.id AS neighbor_id, greatest(a.n2 + b.n2 - 2 * coalesce(d.dot, 0), 0) AS dist FROM n a CROSS JOIN n b LEFT JOIN d ON d.i = a.id AND d.j = b.id"))
def exact_knn_sparse(spark, sf_dir):
    points = sparse_sp(spark, sf_dir)
    return rounded(search.exact_knn_sparse(points, points, K))


SPARSE_EXACT = f"WITH {SP}, {SPARSE_PAIRS} " + ranked("SELECT a.id AS query_id, b.id AS neighbor_id, greatest(a.n2 + b.n2 - 2 * coalesce(d.dot, 0), 0) AS dist FROM n a CROSS JOIN n b LEFT JOIN d ON d.i = a.id AND d.j = b.id")


@query(SPARSE_EXACT)
def exact_knn_sparse_chunked(spark, sf_dir):
    points = sparse_sp(spark, sf_dir)
    return rounded(search.exact_knn_sparse_chunked(points, points, K, [F.col("id") % 3 == i for i in range(3)]))


@query(f"WITH {P} SELECT q.id AS i, r.id AS j, round({sqd('q.e', 'r.e')}, 6) AS dist FROM p q, p r")
def pairwise_sqdist(spark, sf_dir):
    twins.share_values(spark)
    points = dense(spark, sf_dir)
    return search.pairwise_sqdist(points, points, digits=6)


@query(f"WITH {P} SELECT id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS sqnorm FROM p")
def row_norms(spark, sf_dir):
    return rounded(dense(spark, sf_dir).select("id", vectors.sqnorm("embedding").alias("sqnorm")), "sqnorm")


@query(f"WITH {S} SELECT p.id, round(coalesce(sum(s.val * s.val), 0), 6) AS sqnorm FROM p LEFT JOIN s ON s.id = p.id GROUP BY 1")
def row_norms_sparse(spark, sf_dir):
    return rounded(sparse.row_norms(sparse_emb(spark, sf_dir), dense(spark, sf_dir)), "sqnorm")


@query(f"WITH {P}, q AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT id, list_transform(e, lambda x: 3 * x) AS e FROM p)) SELECT id, i - 1 AS pos, round(e[i] / n, 6) AS val FROM q, range(1, 65) t(i)")
def normalize_rows(spark, sf_dir):
    scaled = dense(spark, sf_dir).select("id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    out = scaled.select("id", F.posexplode(vectors.normalize("e")).alias("pos", "val"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "val")


@query(f"WITH {P} SELECT id, CASE WHEN list_sum(list_transform(e, lambda x: x * x)) - 1 > 1e-8 THEN 1 ELSE 0 END AS above FROM p")
def clamp_distance(spark, sf_dir):
    return dense(spark, sf_dir).select("id", (vectors.clamp(vectors.sqnorm("embedding") - 1, 1e-8) > 0).cast("int").alias("above"))


# ---- products -----------------------------------------------------------------------------------


@query(f"WITH {P} SELECT id, level, round(proj, 6) AS proj FROM (" + " UNION ALL ".join(f"SELECT id, {l} AS level, {proj('e', d)} AS proj FROM p" for l, d in enumerate(directions(0))) + ")")
def project_dense(spark, sf_dir):
    out = tree.project_dense(dense(spark, sf_dir), directions(0)).select("id", F.posexplode("proj").alias("level", "proj"))
    return rounded(out, "proj")


ORTHO = orthoproj(WIDTH, 4, 7)


@query(f"WITH {P} SELECT id, level, round(proj, 6) AS proj FROM (" + " UNION ALL ".join(f"SELECT id, {l} AS level, {proj('e', d)} AS proj FROM p" for l, d in enumerate(ORTHO)) + ")")
def orthogonal_projection(spark, sf_dir):
    return rounded(tree.project_dense(dense(spark, sf_dir), ORTHO).select("id", F.posexplode("proj").alias("level", "proj")), "proj")


@query(f"WITH {S}, d AS (SELECT * FROM (VALUES " + ", ".join(f"({l}, {c}, {float(w):.17e})" for l, row in enumerate(directions(0)) for c, w in enumerate(row)) + ") AS v(level, col, weight)) SELECT s.id, d.level, round(sum(s.val * d.weight), 6) AS proj FROM s JOIN d ON s.col = d.col GROUP BY 1, 2")
def project_sparse(spark, sf_dir):
    return rounded(sparse.multiply_dense(sparse_emb(spark, sf_dir), directions_frame(spark, directions(0))), "proj")


@query(f"WITH {S} SELECT a.id AS i, b.id AS j, round(sum(a.val * b.val), 6) AS val FROM s a JOIN s b ON a.col = b.col GROUP BY 1, 2")
def spgemm(spark, sf_dir):
    twins.share_values(spark)
    points = sparse_emb(spark, sf_dir)
    return sparse.inner(points, points, digits=6)


@query(f"WITH {S} SELECT a.id AS i, b.id AS j, round(sum(a.val * b.val), 6) AS val FROM s a JOIN s b ON a.col = b.col GROUP BY 1, 2")
def gram_symmetric(spark, sf_dir):
    twins.share_values(spark)
    return sparse.gram(sparse.rows(sparse_emb(spark, sf_dir)), digits=6)


@query(f"WITH {S}, g AS (SELECT a.id AS i, b.id AS j, sum(a.val * b.val) AS val FROM s a JOIN s b ON a.col = b.col GROUP BY 1, 2) SELECT x.id AS i, y.id AS j, round(coalesce(g.val, 0), 6) AS val FROM p x CROSS JOIN p y LEFT JOIN g ON g.i = x.id AND g.j = y.id")
def spgemm_dense(spark, sf_dir):
    twins.share_values(spark)
    points, ids = sparse_emb(spark, sf_dir), dense(spark, sf_dir)
    return sparse.inner_whole(points, points, ids, ids, digits=6)


@query(f"WITH {S} SELECT CAST(col AS INTEGER) AS row, id AS col, round(val, 6) AS val FROM s")
def transpose(spark, sf_dir):
    return rounded(sparse.transpose(sparse.rows(sparse_emb(spark, sf_dir))), "val")


@query(f"WITH {S}, c AS (SELECT id AS row, count(*) AS nnz FROM s GROUP BY 1) SELECT row, CAST(coalesce(sum(nnz) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, nnz FROM c")
def csr_offsets(spark, sf_dir):
    return sparse.offsets(sparse.rows(sparse_emb(spark, sf_dir)))


@query(f"WITH {S} SELECT id AS row, row_number() OVER (ORDER BY id, col) - 1 AS pos FROM s")
def csr_row_index(spark, sf_dir):
    return sparse.row_index(sparse.offsets(sparse.rows(sparse_emb(spark, sf_dir))))


@query(f"WITH {S}, b AS (SELECT id % 5 AS block, id // 5 AS row, col, val FROM s) SELECT x.block, x.row AS i, y.row AS j, round(sum(x.val * y.val), 6) AS val FROM b x JOIN b y ON x.block = y.block AND x.col = y.col GROUP BY 1, 2, 3")
def blockdiag_spgemm(spark, sf_dir):
    a = sparse_emb(spark, sf_dir).select((F.col("id") % 5).alias("block"), F.expr("id div 5").alias("row"), "col", "val")
    b = a.select("block", F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return sparse.multiply_blocks(a, b, digits=6)


@query(f"WITH {S} SELECT avg(c) AS avg_nnz, max(c) AS max_nnz, min(c) AS min_nnz FROM (SELECT id, count(*) AS c FROM s GROUP BY 1)")
def nnz_stats(spark, sf_dir):
    return sparse.nnz_stats(sparse_emb(spark, sf_dir))


@query(f"WITH {S} SELECT p.id, i - 1 AS pos, round(coalesce(s.val, 0), 6) AS val FROM p CROSS JOIN range(1, 65) t(i) LEFT JOIN s ON s.id = p.id AND s.col = i - 1 WHERE p.id IN (SELECT id FROM s)")
def densify(spark, sf_dir):
    out = vectors.densify(sparse_emb(spark, sf_dir), WIDTH).select("id", F.posexplode("embedding").alias("pos", "val"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "val")


# ---- trees --------------------------------------------------------------------------------------


@query(f"WITH {P}, {leaves_sql(0, 't0')} SELECT id, leaf_id FROM t0")
def tree_leaves(spark, sf_dir):
    return tree.assign_leaves(tree.project_dense(dense(spark, sf_dir), directions(0)), LEVELS)


@query(f"WITH {P}, {leaves_sql(0, 't0')} SELECT id, leaf_id FROM t0")
def tree_leaves_by_ranges(spark, sf_dir):
    return tree.assign_leaves(tree.project_dense(dense(spark, sf_dir), directions(0)), LEVELS, node_rows=100)


@query(f"WITH {S}, {leaves_sql(0, 't0', sparse_=True)} SELECT id, leaf_id FROM t0")
def tree_leaves_sparse(spark, sf_dir):
    return tree.assign_leaves(tree.project_sparse(sparse_emb(spark, sf_dir), directions(0), dense(spark, sf_dir)), LEVELS)


@query(f"WITH {P}, {leaves_sql(0, 't0')}, c AS (SELECT leaf_id, count(*) AS size FROM t0 GROUP BY 1) SELECT leaf_id, CAST(coalesce(sum(size) OVER (ORDER BY leaf_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, size FROM c")
def leaf_intervals(spark, sf_dir):
    return tree.leaf_intervals(tree_leaves(spark, sf_dir))


MEDIANS = " UNION ALL ".join(f"SELECT {l} AS level, leaf_id >> {LEVELS - l} AS node, min(x{l}) AS median FROM t0 WHERE (leaf_id >> {LEVELS - l - 1}) % 2 = 1 GROUP BY 2" for l in range(LEVELS))


@query(f"WITH {P}, {leaves_sql(0, 't0')} SELECT level, CAST(node AS BIGINT) AS node, round(median, 6) AS median FROM ({MEDIANS})")
def node_medians(spark, sf_dir):
    projected = tree.project_dense(dense(spark, sf_dir), directions(0))
    return rounded(tree.node_medians(projected, tree.assign_leaves(projected, LEVELS), LEVELS), "median")


@query(f"WITH {P}, x AS (SELECT id, {proj('e', directions(0)[0])} AS value FROM p) SELECT id, round(value, 6) AS value FROM x ORDER BY value, id LIMIT 1 OFFSET 199")
def dist_select(spark, sf_dir):
    projected = tree.project_dense(dense(spark, sf_dir), directions(0)).select("id", F.col("proj")[0].alias("x"))
    return rounded(tree.select_kth(projected, "x", 200), "value")


@query(f"WITH {P}, {leaves_sql(0, 't0')} SELECT CAST(leaf_id >> {LEVELS - 1} AS BIGINT) AS node, count(*) AS size, round(avg(x1), 6) AS mean, round(min(x1), 6) AS low, round(max(x1), 6) AS high, CAST(sum(1 - (leaf_id >> 1) % 2) AS BIGINT) AS n_left, CAST(sum((leaf_id >> 1) % 2) AS BIGINT) AS n_right FROM t0 GROUP BY 1")
def projection_stats(spark, sf_dir):
    projected = tree.project_dense(dense(spark, sf_dir), directions(0))
    return rounded(tree.projection_stats(projected, tree.assign_leaves(projected, LEVELS), 1, LEVELS), "mean", "low", "high")


@query("SELECT n, leafsize, CAST(ceil(log2(ceil(n / leafsize))) AS BIGINT) AS levels FROM (SELECT count(*) AS n FROM embeddings), (VALUES (64), (100), (512), (1024)) AS v(leafsize) WHERE n > leafsize")
def tree_depth(spark, sf_dir):
    n = dense(spark, sf_dir).count()
    return spark.createDataFrame([(n, s, tree.tree_levels(n, s)) for s in (64, 100, 512, 1024) if n > s], "n long, leafsize int, levels long")


def _route(level: int) -> str:
    return f"b{level + 1} AS (SELECT b.id, {', '.join(f'x{m}' for m in range(LEVELS))}, b.bin * 2 + CASE WHEN x{level} >= m.median THEN 1 ELSE 0 END AS bin FROM b{level} b LEFT JOIN m ON m.level = {level} AND m.node = b.bin)"


BINS = f"{leaves_sql(0, 't0')}, m AS ({MEDIANS}), b0 AS (SELECT id, 0 AS bin, " + ", ".join(f"{proj('e', d)} AS x{l}" for l, d in enumerate(directions(0))) + f" FROM p), " + ", ".join(_route(l) for l in range(LEVELS))


@query(f"WITH {P}, {BINS} SELECT id, CAST(bin AS BIGINT) AS leaf_id FROM b{LEVELS}")
def bin_queries(spark, sf_dir):
    points = dense(spark, sf_dir)
    projected = tree.project_dense(points, directions(0))
    medians = tree.node_medians(projected, tree.assign_leaves(projected, LEVELS), LEVELS)
    return tree.bin_queries(projected, medians, LEVELS)


# ---- leaves and forests -------------------------------------------------------------------------


@query(f"WITH {P}, {leaves_sql(0, 't0')} {ranked(leaf_pairs_sql('t0'))}")
def leaf_knn(spark, sf_dir):
    return rounded(search.leaf_knn(tree_leaves(spark, sf_dir).join(dense(spark, sf_dir), "id"), K))


@query(f"WITH {P}, {leaves_sql(0, 't0')} {ranked(leaf_pairs_sql('t0'))}")
def leaf_knn_sql(spark, sf_dir):
    return rounded(search.leaf_knn(tree_leaves(spark, sf_dir).join(dense(spark, sf_dir), "id"), K, engine="sql"))


@query(f"WITH {S}, {leaves_sql(0, 't0', sparse_=True)}, {SPARSE_PAIRS} " + ranked("SELECT a.id AS query_id, b.id AS neighbor_id, greatest(coalesce(x.n2, 0) + coalesce(y.n2, 0) - 2 * coalesce(d.dot, 0), 0) AS dist FROM t0 a JOIN t0 b ON a.leaf_id = b.leaf_id LEFT JOIN n x ON x.id = a.id LEFT JOIN n y ON y.id = b.id LEFT JOIN d ON d.i = a.id AND d.j = b.id").replace("ORDER BY dist, neighbor_id", "ORDER BY round(dist, 9), neighbor_id"))
def leaf_knn_sparse(spark, sf_dir):
    return rounded(search.leaf_knn_sparse(sparse_emb(spark, sf_dir), tree_leaves_sparse(spark, sf_dir), K))


OVERLAP = 20


@query(f"WITH {P}, {leaves_sql(0, 't0')}, o AS (SELECT id, leaf_id, row_number() OVER (ORDER BY leaf_id, id) - 1 AS pos FROM t0), w AS (SELECT leaf_id, min(pos) - {OVERLAP} AS low, max(pos) + {OVERLAP} AS high FROM o GROUP BY 1) " + ranked(f"SELECT a.id AS query_id, b.id AS neighbor_id, {sqd('x.e', 'y.e')} AS dist FROM o a JOIN w ON w.leaf_id = a.leaf_id JOIN o b ON b.pos BETWEEN w.low AND w.high JOIN p x ON x.id = a.id JOIN p y ON y.id = b.id"))
def leaf_knn_overlap(spark, sf_dir):
    ordered = tree.tree_order(tree_leaves(spark, sf_dir)).join(dense(spark, sf_dir), "id")
    return rounded(search.leaf_knn_overlap(ordered, K, OVERLAP))


ALL = range(TREES)


@query(f"WITH {P}, {forest_ctes(ALL)} {ranked(forest_pairs(ALL))}")
def forest_knn(spark, sf_dir):
    return rounded(small_forest(dense(spark, sf_dir)).all_search(K, TREES, batch=TREES))


@query(f"WITH {P}, {forest_ctes(ALL)} {ranked(forest_pairs(ALL))}")
def forest_knn_by_tree(spark, sf_dir):
    return rounded(small_forest(dense(spark, sf_dir)).all_search(K, TREES))


@query(f"WITH {P}, {forest_ctes(ALL)} {ranked(forest_pairs(ALL))}")
def forest_knn_large(spark, sf_dir):
    """The path of sets too large for a task a tree."""
    return rounded(small_forest(dense(spark, sf_dir), fused_rows=0).all_search(K, TREES, batch=TREES))


@query(f"WITH {P}, {forest_ctes(ALL)} {ranked(forest_pairs(ALL))}")
def forest_overlap_search(spark, sf_dir):
    return rounded(small_forest(dense(spark, sf_dir)).overlap_search(K, TREES))


@query(f"WITH {P}, {forest_ctes(ALL)} {ranked(forest_pairs(ALL))}")
def forest_refine(spark, sf_dir):
    forest = small_forest(dense(spark, sf_dir))
    return rounded(forest.refine(forest.all_search(K, 1), K, [1, 2]))


@query(f"WITH {P}, {forest_ctes(range(2))} {ranked(forest_pairs(range(2)))}")
def forest_monitored(spark, sf_dir):
    """A monitor that ends the search after two trees."""
    return rounded(small_forest(dense(spark, sf_dir)).all_search(K, TREES, monitor=lambda trees, found: trees == 2))


@query(f"WITH {P}, {forest_ctes(range(1))} {ranked(forest_pairs(range(1)))}")
def forest_early_stop(spark, sf_dir):
    """A recall that the first tree passes."""
    points = dense(spark, sf_dir)
    truth = materialize(search.exact_knn(points, points, K), "truth")
    return rounded(small_forest(points).all_search(K, TREES, truth=truth, threshold=0.05))


@query(f"WITH {P}, {forest_ctes(range(1))}, {'truth AS (' + topk_sql(EXACT) + ')'}, approx AS ({topk_sql(forest_pairs(range(1)))}) SELECT CAST(0 AS INTEGER) AS tree, 'recall' AS metric, round((SELECT count(*) FROM approx JOIN (SELECT query_id, max(dist) AS kth FROM truth GROUP BY 1) USING (query_id) WHERE dist <= kth + 1e-9) / (SELECT count(*) FROM truth), 6) AS value")
def forest_record(spark, sf_dir):
    """What the search records of its trees."""
    points = dense(spark, sf_dir)
    truth = materialize(search.exact_knn(points, points, K), "truth")
    forest = small_forest(points)
    forest.all_search(K, TREES, truth=truth, threshold=0.05)
    path = fresh_path(spark, "record")
    forest.recorder.write(spark, path)
    return rounded(spark.read.schema("tree int, metric string, value double").csv(path, header=True), "value")


SPARSE_FOREST = deduped(" UNION ALL ".join(f"SELECT a.id AS query_id, b.id AS neighbor_id, greatest(coalesce(x.n2, 0) + coalesce(y.n2, 0) - 2 * coalesce(d.dot, 0), 0) AS dist FROM t{t} a JOIN t{t} b ON a.leaf_id = b.leaf_id LEFT JOIN n x ON x.id = a.id LEFT JOIN n y ON y.id = b.id LEFT JOIN d ON d.i = a.id AND d.j = b.id" for t in range(2)))


@query(f"WITH {S}, {leaves_sql(0, 't0', sparse_=True)}, {leaves_sql(1, 't1', sparse_=True)}, {SPARSE_PAIRS} {ranked(SPARSE_FOREST).replace('ORDER BY dist, neighbor_id', 'ORDER BY round(dist, 9), neighbor_id')}")
def forest_knn_sparse(spark, sf_dir):
    forest = Forest(sparse_emb(spark, sf_dir), levels=LEVELS, width=WIDTH, directions=directions, ids=dense(spark, sf_dir))
    return rounded(forest.all_search(K, 2, batch=2))


@query(f"WITH {P}, {BINS} " + ranked(f"SELECT q.id AS query_id, t.id AS neighbor_id, {sqd('x.e', 'y.e')} AS dist FROM b{LEVELS} q JOIN t0 t ON t.leaf_id = q.bin JOIN p x ON x.id = q.id JOIN p y ON y.id = t.id"))
def forest_query_search(spark, sf_dir):
    points = dense(spark, sf_dir)
    return rounded(small_forest(points).query_search(points, K, 1))


# ---- merging, sorting, metrics ------------------------------------------------------------------

ONE, TWO = topk_sql(leaf_pairs_sql("t0")), topk_sql(leaf_pairs_sql("t1"))
TRUTH = f"truth AS ({topk_sql(EXACT)})"
APPROX = f"approx AS ({topk_sql(deduped(ONE + ' UNION ALL ' + TWO))})"
KTH = "kth AS (SELECT query_id, max(dist) AS kth, count(*) AS n FROM truth GROUP BY 1)"
PAIR = f"WITH {P}, {forest_ctes(range(2))}, {TRUTH}, {APPROX}, {KTH}"


def _pair(spark, sf_dir):
    """(truth, approx) of all points, approx from two trees; both written, for they are read repeatedly."""
    points = dense(spark, sf_dir)
    truth = search.exact_knn(points, points, K)
    approx = small_forest(points, fused_rows=0)
    both = merge.merge_neighbors(approx.candidates([0], K), approx.candidates([1], K), k=K)
    return materialize(truth, "truth"), materialize(both, "approx")


@query(f"WITH {P}, {forest_ctes(range(2))} {ranked(deduped(ONE + ' UNION ALL ' + TWO))}")
def merge_neighbors(spark, sf_dir):
    forest = small_forest(dense(spark, sf_dir))
    a, b = (merge.top_k(forest.candidates([t], K), K) for t in range(2))
    return rounded(merge.merge_neighbors(a, b, k=K))


@query(f"WITH {P}, x AS (SELECT id, i - 1 AS pos, e[i] AS val, row_number() OVER (PARTITION BY id ORDER BY e[i], i) AS rank FROM p, range(1, 65) t(i)) SELECT id, rank, pos, round(val, 6) AS val FROM x WHERE rank <= 5")
def row_topk(spark, sf_dir):
    return rounded(merge.row_topk(dense(spark, sf_dir), "embedding", 5), "val")


@query(f"WITH {P} SELECT id, row_number() OVER (PARTITION BY id ORDER BY e[i], i) AS rank, i - 1 AS pos, round(e[i], 6) AS val FROM p, range(1, 65) t(i)")
def sort_rows(spark, sf_dir):
    return rounded(merge.sort_rows(dense(spark, sf_dir), "embedding"), "val")


@query(f"WITH {P} {ranked(EXACT, 3)}")
def first_columns(spark, sf_dir):
    return merge.first_columns(exact_knn(spark, sf_dir), 3)


@query(f"WITH {P} SELECT row_number() OVER (ORDER BY e[1], id) - 1 AS pos, id FROM p")
def argsort(spark, sf_dir):
    return exchange.argsort(dense(spark, sf_dir).select("id", F.col("embedding")[0].alias("x")), "x")


@query(PAIR + " SELECT (SELECT count(*) FROM approx JOIN kth USING (query_id) WHERE dist <= kth + 1e-9) / (SELECT sum(n) FROM kth) AS recall")
def recall_distance(spark, sf_dir):
    truth, approx = _pair(spark, sf_dir)
    return metrics.recall_distance(truth, approx, 1e-9)


@query(PAIR + " SELECT (SELECT count(*) FROM approx JOIN truth USING (query_id, neighbor_id)) / (SELECT sum(n) FROM kth) AS recall")
def recall_ids(spark, sf_dir):
    return metrics.recall_ids(*_pair(spark, sf_dir))


@query(PAIR + ", ks AS (SELECT * FROM (VALUES (2), (4), (6), (8)) AS v(k)), f AS (SELECT k, query_id, max(dist) AS far, count(*) AS n FROM truth, ks WHERE rank <= k GROUP BY 1, 2) SELECT CAST(f.k AS BIGINT) AS k, sum((SELECT count(*) FROM approx a WHERE a.query_id = f.query_id AND a.rank <= f.k AND a.dist <= f.far + 1e-9)) / sum(f.n) AS recall FROM f GROUP BY 1")
def recall_at_k(spark, sf_dir):
    return metrics.recall_at_k(*_pair(spark, sf_dir), tolerance=1e-9)


@query(PAIR + ", ks AS (SELECT * FROM (VALUES (2), (4), (6), (8)) AS v(k)) SELECT CAST(ks.k AS BIGINT) AS k, (SELECT count(*) FROM approx a JOIN truth t USING (query_id, neighbor_id) WHERE a.rank <= ks.k AND t.rank <= ks.k) / (SELECT count(*) FROM truth t WHERE t.rank <= ks.k) AS recall FROM ks")
def recall_at_k_ids(spark, sf_dir):
    return metrics.recall_at_k(*_pair(spark, sf_dir), id_only=True)


@query(PAIR + " SELECT (SELECT count(*) FROM approx JOIN kth USING (query_id) WHERE dist <= kth + 1e-9) / (SELECT sum(n) FROM kth) AS recall, (SELECT round(avg(abs(got - kth) / kth), 6) FROM kth JOIN (SELECT query_id, max(dist) AS got FROM approx GROUP BY 1) USING (query_id)) AS rel_err, (SELECT round(avg(dist), 6) FROM approx) AS mean_sim")
def check_accuracy(spark, sf_dir):
    return rounded(metrics.check_accuracy(*_pair(spark, sf_dir), tolerance=1e-9), "rel_err", "mean_sim")


@query(PAIR + " SELECT round(avg(abs(got - kth) / kth), 6) AS rel_err FROM kth JOIN (SELECT query_id, max(dist) AS got FROM approx GROUP BY 1) USING (query_id)")
def rel_err(spark, sf_dir):
    return rounded(metrics.kth_error(*_pair(spark, sf_dir)), "rel_err")


@query(PAIR + " SELECT round(avg(dist), 6) AS mean_sim FROM approx")
def mean_sim(spark, sf_dir):
    return rounded(metrics.mean_sim(_pair(spark, sf_dir)[1]), "mean_sim")


@query(PAIR + " SELECT query_id, round(avg(dist), 6) AS mean_sim FROM approx GROUP BY 1")
def row_mean_sim(spark, sf_dir):
    return rounded(metrics.row_mean_sim(_pair(spark, sf_dir)[1]), "mean_sim")


@query(PAIR + " SELECT round(sqrt(sum((a.dist - t.dist) * (a.dist - t.dist))) / sqrt(sum(t.dist * t.dist)), 6) AS frob_err FROM truth t JOIN approx a USING (query_id, rank)")
def frob_error(spark, sf_dir):
    return rounded(metrics.frobenius_error(*_pair(spark, sf_dir)), "frob_err")


@query(PAIR + " SELECT count(*) AS misses FROM approx a JOIN kth USING (query_id) WHERE a.dist > kth * (1 + 1e-6) AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = a.query_id AND t.neighbor_id = a.neighbor_id)")
def miss_count(spark, sf_dir):
    return metrics.miss_count(*_pair(spark, sf_dir))


@query(PAIR + ", w AS (SELECT t.query_id, min(CASE WHEN a.dist IS NULL OR abs(a.dist - t.dist) > 1e-6 * greatest(1, t.dist) THEN t.rank END) AS f, max(t.rank) AS k FROM truth t LEFT JOIN approx a USING (query_id, rank) GROUP BY 1) SELECT CAST(coalesce(sum(k - f + 1), 0) AS BIGINT) AS misses FROM w WHERE f IS NOT NULL")
def miss_count_tol(spark, sf_dir):
    return metrics.miss_count_tolerance(*_pair(spark, sf_dir))


@query(PAIR + " SELECT avg(CASE WHEN s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS match FROM (SELECT t.query_id, bool_and(coalesce(a.neighbor_id = t.neighbor_id, false)) AS s FROM truth t LEFT JOIN approx a USING (query_id, rank) GROUP BY 1)")
def strict_match(spark, sf_dir):
    return metrics.strict_match(*_pair(spark, sf_dir))


# ---- movement -----------------------------------------------------------------------------------

WANTED = "SELECT (vec_id * 37) % (SELECT count(*) FROM embeddings) AS id FROM embeddings"


def _wanted(points):
    """As many requests as rows, some for one row."""
    return points.select(((F.col("id") * 37) % points.count()).alias("id"))


@query(f"WITH {P}, w AS ({WANTED}) SELECT w.id, round(p.e[1], 6) AS first FROM w JOIN p USING (id)")
def gather_rows(spark, sf_dir):
    return rounded(exchange.gather(dense(spark, sf_dir), _wanted(dense(spark, sf_dir))).select("id", F.col("embedding")[0].cast("double").alias("first")), "first")


@query(f"WITH {S}, w AS (SELECT DISTINCT id FROM ({WANTED})) SELECT s.id, CAST(s.col AS INTEGER) AS col, round(s.val, 6) AS val FROM w JOIN s ON s.id = w.id")
def gather_sparse_rows(spark, sf_dir):
    return rounded(exchange.gather(sparse_emb(spark, sf_dir), _wanted(dense(spark, sf_dir)).distinct()), "val")


@query(f"WITH {P} SELECT row_number() OVER (ORDER BY id DESC) - 1 AS pos, round(e[1], 6) AS first FROM p")
def permute_rows(spark, sf_dir):
    """All rows in reverse."""
    rows = dense(spark, sf_dir).select("id", F.col("embedding")[0].cast("double").alias("first"))
    order = exchange.global_rank(rows.select("id"), [], ["id"], "place").select((rows.count() - F.col("place")).alias("pos"), F.col("id").alias("src"))
    return rounded(exchange.permute(rows, order), "first")


@query(f"WITH {P} {ranked(EXACT)}")
def redistribute(spark, sf_dir):
    return exchange.redistribute(exact_knn(spark, sf_dir))


BOUNDS = [0, 100, 250, 251, 400]


@query(f"WITH {P}, b AS (SELECT *, row_number() OVER (ORDER BY start) - 1 AS o FROM (VALUES " + ", ".join(f"({b})" for b in BOUNDS) + ") AS v(start)) SELECT id, CAST(max(o) AS INTEGER) AS owner, id - max(start) AS local FROM p JOIN b ON start <= id GROUP BY id")
def owner_label(spark, sf_dir):
    return dense(spark, sf_dir).select("id", exchange.owner("id", BOUNDS).alias("owner"), exchange.local_index("id", BOUNDS).alias("local"))


@query("SELECT key, min(pos) AS start, count(*) AS size FROM (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS pos, label AS key FROM embeddings) GROUP BY 1")
def ordered_sizes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("key"))
    ranked_ = exchange.global_rank(rows, [], ["key", "id"], "pos").withColumn("pos", F.col("pos") - 1)
    return exchange.ordered_sizes(ranked_, "key", "pos")


@query("WITH c AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1) SELECT key, n, CAST(coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM c")
def prefix_sum(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sparse.prefix_sums(counts, "key", "n")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id >= 50 AND vec_id < 150")
def slice_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    return exchange.block(rows, "id", 50, 150)


# ---- files: written, then read back --------------------------------------------------------------

ENTRIES = f"WITH {S} SELECT id, CAST(col AS INTEGER) AS col, round(CAST(CAST(val AS FLOAT) AS DOUBLE), 6) AS val FROM s"


def _folder(spark: SparkSession) -> str:
    """A fresh folder that the driver can write one-file formats to."""
    path = local_path(fresh_path(spark, "files"))
    if path is None:
        raise NotImplementedError("formats of one file are written by the driver to a mounted shared folder")
    os.makedirs(path, exist_ok=True)
    return path


def _matrix(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """All embeddings in id order on the driver, which writes the files that hold one matrix."""
    return np.stack([np.asarray(r.embedding, np.float32) for r in dense(spark, sf_dir).orderBy("id").toLocalIterator()])


def _long(df: DataFrame) -> DataFrame:
    """Dense rows as (id, pos, val)."""
    out = df.select("id", F.posexplode("embedding").alias("pos", "val"))
    return rounded(out.select("id", F.col("pos").cast("long").alias("pos"), F.col("val").cast("double").alias("val")), "val")


LONG = "SELECT vec_id AS id, i - 1 AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS val FROM embeddings, range(1, 65) t(i)"
BYTES = "SELECT vec_id AS id, i - 1 AS pos, floor((CAST(embedding[i] AS DOUBLE) + 1) * 100) AS val FROM embeddings, range(1, 65) t(i)"


def _bytes(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return np.floor((_matrix(spark, sf_dir).astype(float) + 1) * 100).astype(np.uint8)


@query(ENTRIES)
def read_csr_rows(spark, sf_dir):
    rows = sparse_emb(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    return _entries(readers.read_csr_rows(rows.select("id", F.col("e.col").alias("c"), F.col("e.val").alias("v")), "id", "c", "v"))


@query(f"WITH {S} SELECT row_number() OVER (ORDER BY id) - 1 AS id, CAST(0 AS DOUBLE) AS label FROM (SELECT DISTINCT id FROM s)")
def svm_ids(spark, sf_dir):
    path = fresh_path(spark, "svm")
    writers.write_svm(sparse_emb(spark, sf_dir), path)
    return readers.svm_ids(spark, path)


@query(f"WITH {S} SELECT dense_rank() OVER (ORDER BY id % 2, id) - 1 AS id, CAST(col AS INTEGER) AS col, round(CAST(CAST(val AS FLOAT) AS DOUBLE), 6) AS val FROM s")
def read_svm_files(spark, sf_dir):
    """Several files, one after another, are one set."""
    path, points = fresh_path(spark, "svm"), sparse_emb(spark, sf_dir).withColumn("val", F.col("val").cast("float"))
    for part in (0, 1):
        writers.write_svm(points.filter(F.col("id") % 2 == part), f"{path}/{part}")
    return _entries(readers.read_svm(spark, [f"{path}/0", f"{path}/1"], WIDTH))


@query(ENTRIES)
def read_csr_split(spark, sf_dir):
    folder = _folder(spark)
    arrays = writers.csr_arrays(sparse_emb(spark, sf_dir), dense(spark, sf_dir).count())
    for name, own in zip(("starts", "columns", "values"), arrays):
        own.tofile(f"{folder}/{name}")
    return _entries(readers.read_csr_split(spark, *[f"file://{folder}/{n}" for n in ("starts", "columns", "values")]))


@query(BYTES)
def read_idx(spark, sf_dir):
    path, x = f"{_folder(spark)}/images.idx", _bytes(spark, sf_dir)
    with open(path, "wb") as f:
        f.write(bytes([0, 0, 8, 3]) + np.array([len(x), 8, 8], ">i4").tobytes() + x.tobytes())
    return _long(readers.read_idx(spark, f"file://{path}"))


@query(f"{BYTES} WHERE vec_id >= 30 AND vec_id < 90")
def read_bvecs(spark, sf_dir):
    """A range of the records, which is the reader's feature."""
    path, x = f"{_folder(spark)}/points.bvecs", _bytes(spark, sf_dir)
    np.hstack([np.full((len(x), 1), WIDTH, "<i4").view(np.uint8), x]).tofile(path)
    return _long(readers.read_bvecs(spark, f"file://{path}", WIDTH, 30, 60))


@query(LONG)
def read_npy(spark, sf_dir):
    """Two shards in the order given."""
    folder, x = _folder(spark), _matrix(spark, sf_dir)
    for name, part in (("b", x[:70]), ("a", x[70:])):
        np.save(f"{folder}/{name}.npy", part)
    return _long(readers.read_npy(spark, [f"file://{folder}/{n}.npy" for n in "ba"]))


@query(f"{LONG} WHERE vec_id < 90")
def read_npy_limit(spark, sf_dir):
    path = f"{_folder(spark)}/points.npy"
    np.save(path, _matrix(spark, sf_dir))
    return _long(readers.read_npy(spark, f"file://{path}", limit=90))


@query(f"WITH {P} {ranked(EXACT)}")
def read_truth_npy(spark, sf_dir):
    folder, truth = _folder(spark), exact_knn(spark, sf_dir).orderBy("query_id", "rank").toPandas()
    np.save(f"{folder}/ids.npy", truth.neighbor_id.to_numpy().reshape(-1, K))
    np.save(f"{folder}/dists.npy", truth.dist.to_numpy().reshape(-1, K))
    return readers.read_truth_npy(spark, f"file://{folder}/ids.npy", f"file://{folder}/dists.npy")


@query(f"WITH {P} {ranked(EXACT)}")
def write_truth(spark, sf_dir):
    path = fresh_path(spark, "truth")
    writers.write_truth(exact_knn(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(LONG)
def cached(spark, sf_dir):
    """Made once, then read."""
    path = fresh_path(spark, "cached")
    readers.cached(spark, path, lambda: readers.read_dense(spark, f"{sf_dir}/embeddings.parquet", "vec_id"))
    return _long(readers.cached(spark, path, lambda: None))


def _entries(df: DataFrame) -> DataFrame:
    return df.select("id", "col", F.round(F.col("val").cast("double"), 6).alias("val"))


@query(ENTRIES)
def read_svm(spark, sf_dir):
    path = fresh_path(spark, "svm")
    points = sparse_emb(spark, sf_dir)
    writers.write_svm(points.withColumn("val", F.col("val").cast("float")), path)
    return _entries(readers.read_svm(spark, path, WIDTH))


@query(ENTRIES)
def read_csr_binary(spark, sf_dir):
    path = f"{_folder(spark)}/points.bin"
    writers.write_csr_binary(sparse_emb(spark, sf_dir), path, dense(spark, sf_dir).count(), WIDTH)
    return _entries(readers.read_csr_binary(spark, f"file://{path}"))


@query(ENTRIES)
def read_csr_text(spark, sf_dir):
    path = f"{_folder(spark)}/points.txt"
    writers.write_csr_text(sparse_emb(spark, sf_dir), path, dense(spark, sf_dir).count(), WIDTH)
    return _entries(readers.read_csr_text(spark, f"file://{path}"))


@query(LONG)
def read_fvecs(spark, sf_dir):
    path = f"{_folder(spark)}/points.fvecs"
    writers.write_fvecs(dense(spark, sf_dir), path)
    return _long(readers.read_fvecs(spark, f"file://{path}", WIDTH))


@query(f"WITH {P} {ranked(EXACT)}")
def read_truth(spark, sf_dir):
    path = fresh_path(spark, "truth")
    writers.write_matrix_text(exact_knn(spark, sf_dir), path)
    return readers.read_truth_text(spark, path)


# ---- rows only ----------------------------------------------------------------------------------


def _moments(points: DataFrame, width: int, mean: float, var: float) -> DataFrame:
    """Rows, distinct ids, whether all have the width, and whether mean and variance are near a law's."""
    x = points.select("id", F.explode("embedding").alias("x"))
    own = x.agg(F.abs(F.avg("x") - mean).alias("m"), F.abs(F.var_pop("x") - var).alias("v"))
    return points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.bool_and(F.size("embedding") == width).alias("wide")).join(own, F.lit(True)).select("n", "ids", "wide", (F.col("m") < 0.05).alias("mean_near"), (F.col("v") < 0.05).alias("var_near"))


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS ids, true AS wide, true AS mean_near, true AS var_near")
def gaussian_law(spark, sf_dir):
    return _moments(generators.gaussian(spark, 1000, 10), 10, 0.0, 1.0)


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS ids, true AS wide, true AS mean_near, true AS var_near")
def uniform_law(spark, sf_dir):
    return _moments(generators.uniform(spark, 1000, 10), 10, 0.5, 1 / 12)


@query("SELECT CAST(1000 AS BIGINT) AS n, true AS wide, true AS noise_small")
def spheres_law(spark, sf_dir):
    """At most ten coordinates of a row are beyond the noise."""
    points = generators.spheres(spark, 1000, 32)
    far = F.size(F.filter("embedding", lambda x: (x < 0) | (x > 0.0100001)))
    return points.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.size("embedding") == 32).alias("wide"), F.bool_and(far <= 10).alias("noise_small"))


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(10 AS BIGINT) AS low, CAST(10 AS BIGINT) AS high, true AS in_width")
def sparse_fixed_law(spark, sf_dir):
    rows = generators.sparse_rows(spark, 1000, 500, 10, fixed=True)
    held = rows.groupBy("id").agg(F.countDistinct("col").alias("c"), F.max("col").alias("top"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.bool_and(F.col("top") < 500).alias("in_width"))


@query("SELECT true AS avg_near, true AS in_width")
def sparse_variable_law(spark, sf_dir):
    rows = generators.sparse_rows(spark, 1000, 500, 10)
    return rows.agg((F.abs(F.count(F.lit(1)) / 1000 - 10) < 0.5).alias("avg_near"), F.bool_and(F.col("col") < 500).alias("in_width"))


@query("SELECT true AS share_near, true AS below")
def sparse_density_law(spark, sf_dir):
    rows = generators.sparse_density(spark, 500, 100, 0.05)
    return rows.agg((F.abs(F.count(F.lit(1)) / 50000 - 0.05) < 0.005).alias("share_near"), F.bool_and(F.col("val") < 0.05).alias("below"))


@query("SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS held, true AS again")
def sample_rows_law(spark, sf_dir):
    """Rows of the table, none twice, the same for the same seed."""
    points = dense(spark, sf_dir)
    one, two = (exchange.sample_rows(points.repartition(n), 50, seed=3).select("id") for n in (2, 5))
    held = points.join(one, "id", "left_semi").agg(F.countDistinct("id").alias("held"))
    same = one.join(two, "id").agg(F.count(F.lit(1)).alias("n"))
    return same.join(held, F.lit(True)).select("n", "held", (F.col("n") == 50).alias("again"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS val FROM range(8) a(i), range(8) b(j)")
def directions_orthonormal(spark, sf_dir):
    """Directions, kept and loaded again, are orthonormal."""
    path = fresh_path(spark, "directions")
    save_directions(spark, make_directions(WIDTH, 8, 1), path)
    d = directions_frame(spark, load_directions(spark, path))
    a, b = (d.select(F.col("level").alias(n), "col", F.col("weight").alias(w)) for n, w in (("i", "v"), ("j", "w")))
    return a.join(b, "col").groupBy("i", "j").agg((F.round(F.sum(F.col("v") * F.col("w")), 6) + 0.0).alias("val")).withColumn("val", F.abs("val"))


@query()
def sample_rows(spark, sf_dir):
    return exchange.sample_rows(dense(spark, sf_dir), 50, seed=3).select("id")


@query()
def qr_directions(spark, sf_dir):
    return directions_frame(spark, make_directions(WIDTH, 8, 1))


@query()
def generate_gaussian(spark, sf_dir):
    return generators.gaussian(spark, 1000, 10)


@query()
def generate_uniform(spark, sf_dir):
    return generators.uniform(spark, 1000, 10)


@query()
def generate_spheres(spark, sf_dir):
    return generators.spheres(spark, 1000, 32)


@query()
def generate_sparse(spark, sf_dir):
    return generators.sparse_rows(spark, 1000, 500, 10)


@query()
def generate_sparse_density(spark, sf_dir):
    return generators.sparse_density(spark, 500, 100, 0.05)


@query()
def forest_until_recall(spark, sf_dir):
    """Trees are added until the sampled recall passes 0.95."""
    graph, _ = Forest(dense(spark, sf_dir), levels=2, seed=1).search(K, 24, sample=50, batch=8)
    return rounded(graph)
