import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinage.functions import sparse, vectors
from vicinage.operators import exchange, merge, metrics, search, tree
from vicinage.operators.directions import KINDS, load_directions, make_directions, orthoproj, save_directions
from vicinage.operators.forest import Forest, forest_knn
from vicinage.operators.monitor import Profiler, Recorder, SearchError

DENSE = "id long, embedding array<double>"


def points(spark, n=200, d=8, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DENSE)


def brute(x, q, k, ids=None):
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    ids = np.arange(len(x)) if ids is None else ids
    return [[(int(ids[j]), d[i, j]) for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(q))]


def table(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.neighbor_id, r.dist))
    return out


def assert_table(df, expected):
    got = table(df)
    assert len(got) == len(expected)
    for i, rows in enumerate(expected):
        assert [n for n, _ in got[i]] == [n for n, _ in rows]
        assert [v for _, v in got[i]] == pytest.approx([v for _, v in rows], abs=1e-9)


# ---- exact search ----


@pytest.mark.parametrize("engine", ["blocks", "sql"])
def test_exact_search(spark, engine, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "POINT_BLOCK", 13)
    x, df = points(spark)
    assert_table(search.exact_knn(df.filter("id < 20"), df, 5, engine=engine), brute(x, x[:20], 5))


def test_ties_go_to_the_smaller_id_and_self_is_found(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(16)]
    df = spark.createDataFrame(rows, DENSE)
    for engine in ("blocks", "sql"):
        got = table(search.exact_knn(df, df, 3, engine=engine))
        assert [n for n, _ in got[0]] == [0, 2, 4] and [n for n, _ in got[15]] == [1, 3, 5] and got[15][0][1] == 0
        got = table(search.exact_knn(df, df, 3, engine=engine, include_self=False))
        assert [n for n, _ in got[2]] == [0, 4, 6]


def test_more_neighbours_than_points(spark):
    x, df = points(spark, 3)
    assert_table(search.exact_knn(df, df, 10), brute(x, x, 10))


def test_nearly_equal_large_vectors_have_no_negative_distance(spark):
    x = 1e6 + np.random.default_rng(0).standard_normal((50, 4)) * 1e-4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DENSE)
    assert_table(search.exact_knn(df, df, 4), brute(x, x, 4))


def test_chunks_and_partitions_do_not_matter(spark):
    _, df = points(spark)
    whole = table(search.exact_knn(df, df, 4))
    assert table(search.exact_knn(df.repartition(7), df.repartition(3), 4)) == whole
    assert table(search.exact_knn_chunked(df, df, 4, [F.col("id") < 50, F.col("id") >= 50])) == whole


def test_bad_requests(spark):
    _, df = points(spark, 10)
    for bad in (lambda: search.exact_knn(df, df, 0), lambda: search.exact_knn(df, df, 1, metric="cosine"), lambda: search.exact_knn(df, df, 1, engine="?"), lambda: make_directions(3, 2, 0, "?"), lambda: merge.merge_neighbors(k=2), lambda: Forest(df, levels=4), lambda: Forest(df.filter("id < 0")), lambda: Forest(df.select("id")), lambda: Forest(df).all_search(0), lambda: tree.tree_levels(0, 5)):
        with pytest.raises(ValueError):
            bad()
    assert issubclass(SearchError, ValueError)


# ---- sparse ----


def sparse_points(spark, n=40, d=30, density=0.08, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 9, (n, d)) * (rng.random((n, d)) < density)
    x[5] = 0  # a row without entries
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return x.astype(float), spark.createDataFrame(rows, "id long, col int, val double"), spark.range(n)


def test_sparse_exact_search_with_disjoint_and_empty_rows(spark):
    x, s, ids = sparse_points(spark)
    assert_table(search.exact_knn_sparse(s, s, 6, query_ids=ids, point_ids=ids), brute(x, x, 6))
    got = table(search.exact_knn_sparse(s, s, 6, query_ids=ids, point_ids=ids, include_self=False))
    assert all(i not in [n for n, _ in rows] and len(rows) == 6 for i, rows in got.items())
    assert_table(search.exact_knn_sparse(s, s, 100, query_ids=ids, point_ids=ids), brute(x, x, 100))


def test_sparse_products(spark):
    x, s, _ = sparse_points(spark)
    a = sparse.rows(s)

    def dense(df, shape):
        out = np.zeros(shape)
        for r in df.collect():
            out[r[0], r[1]] = r[2]
        return out

    assert np.allclose(dense(sparse.multiply(a, sparse.transpose(a)), (40, 40)), x @ x.T)
    assert np.allclose(dense(sparse.gram(a), (40, 40)), x @ x.T)
    starts = {r.row: (r.start, r.nnz) for r in sparse.offsets(a).collect()}
    counts = (x != 0).sum(1)
    assert starts == {i: (int(counts[:i].sum()), int(c)) for i, c in enumerate(counts) if c}
    assert sorted(r.row for r in sparse.row_index(sparse.offsets(a)).collect()) == np.repeat(np.arange(40), counts).tolist()
    back = {r.id: r.embedding for r in vectors.densify(s, 30).collect()}
    assert all(back[i] == x[i].tolist() for i in back) and 5 not in back


def test_sparse_leaves_equal_dense_ones(spark):
    x, s, ids = sparse_points(spark, 64, 20, 0.3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DENSE)
    d = make_directions(20, 2, 3)
    a = dict(tree.assign_leaves(tree.project_sparse(s, d, ids), 2).collect())
    assert len(a) == 64 and sorted(np.bincount(list(a.values()))) == [16] * 4
    leaves = spark.createDataFrame(list(a.items()), "id long, leaf_id long")
    one, two = table(search.leaf_knn_sparse(s, leaves, 3)), table(search.leaf_knn(leaves.join(df, "id"), 3))
    assert one.keys() == two.keys() and all([v for _, v in one[i]] == pytest.approx([v for _, v in two[i]], abs=1e-9) for i in one)
    forest = Forest(s, levels=2, width=20, ids=ids, seed=4)
    assert len(table(forest.all_search(3, 2, batch=2))) == 64


# ---- trees ----


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), levels=st.integers(0, 4), kinds=st.integers(1, 5), seed=st.integers(0, 99))
def test_leaves_by_windows_ranges_and_numpy(spark, n, levels, kinds, seed):
    """Ties included, the three ways agree, leaves are balanced, and every row is in one."""
    rng = np.random.default_rng(seed)
    proj = rng.integers(0, kinds, (n, max(levels, 1))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(proj)], "id long, proj array<double>")
    one = dict(tree.assign_leaves(df, levels).collect())
    assert one == dict(enumerate(tree.local_leaves(proj, np.arange(n), levels).tolist()))
    if n > 40:
        assert one == dict(tree.assign_leaves(df, levels, node_rows=10).collect())
    sizes = np.bincount(list(one.values()), minlength=2**levels)
    assert len(one) == n and sizes.max() - sizes.min() <= 1 and sizes.sum() == n


def test_queries_reach_the_leaf_of_their_own_point(spark):
    _, df = points(spark, 128)
    d = make_directions(8, 3, 5)
    projected = tree.project_dense(df, d)
    leaves = tree.assign_leaves(projected, 3)
    bins = tree.bin_queries(projected, tree.node_medians(projected, leaves, 3), 3)
    assert dict(bins.collect()) == dict(leaves.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_directions(spark, kind, tmp_path):
    d = make_directions(6, 4, 1, kind)
    assert d.shape == (4, 6) and (d == make_directions(6, 4, 1, kind)).all() and (d != make_directions(6, 4, 2, kind)).any()
    if kind.endswith("qr"):
        assert np.allclose(d @ d.T, np.eye(4))
        more = make_directions(3, 7, 1, kind)
        assert more.shape == (7, 3) and all(any(np.allclose(v, w) for w in more[:3]) for v in more[3:])
    save_directions(spark, d, str(tmp_path / kind))
    assert (load_directions(spark, str(tmp_path / kind)) == d).all()
    assert np.allclose((o := orthoproj(4, 6, 0))[:4] @ o[:4].T, np.eye(4)) and o.shape == (6, 4)


def test_select_kth(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 3000).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    order = np.lexsort((np.arange(3000), x))
    for k in (1, 2, 1500, 2999, 3000):
        r = tree.select_kth(df, "x", k).first()
        assert (r.id, r.value) == (order[k - 1], x[order[k - 1]])
    with pytest.raises(ValueError):
        tree.select_kth(df, "x", 0)


def test_tree_levels():
    assert [tree.tree_levels(n, 512) for n in (1, 512, 513, 1024, 1025, 2**20)] == [0, 0, 1, 1, 2, 11]
    assert tree.tree_levels(2**20, 512, 5) == 5


# ---- forests ----


def test_no_levels_is_exact(spark):
    x, df = points(spark)
    assert_table(Forest(df, levels=0).all_search(5, 1), brute(x, x, 5))


def test_all_paths_agree_and_recall_grows(spark):
    x, df = points(spark, 256, 6)
    truth = search.exact_knn(df, df, 5)
    forest = Forest(df, levels=3, seed=2)
    whole = table(forest.all_search(5, 4, truth=truth, threshold=2.0))
    recalls = forest.recorder.values["recall"]
    assert len(recalls) == 4 and recalls == sorted(recalls) and recalls[-1] > 0.8
    assert table(Forest(df, levels=3, seed=2, fused_rows=0).all_search(5, 4, batch=4)) == whole
    assert table(forest.overlap_search(5, 4)) == whole
    assert table(forest_knn(df, 5, 4, levels=3, seed=2)) == whole
    assert all(rows[0] == (i, 0.0) and [v for _, v in rows] == sorted(v for _, v in rows) for i, rows in whole.items())
    refined = forest.refine(forest.all_search(5, 2), 5, [2, 3])
    assert table(refined) == whole
    assert "3 levels" in str(forest) and forest.profiler.seconds["trees"] > 0


def test_early_stop_and_monitor(spark):
    _, df = points(spark, 256, 4)
    forest = Forest(df, levels=2)
    truth = search.exact_knn(df.filter("id < 50"), df, 4)
    forest.all_search(4, 30, truth=truth, threshold=0.6)
    assert len(forest.recorder.values["recall"]) < 30
    seen = []
    Forest(df, levels=2).all_search(4, 9, monitor=lambda t, r: seen.append((t, r.count())) or t >= 3)
    assert [t for t, _ in seen] == [1, 2, 3] and seen[0][1] == 4 * 256


def test_search_reports_recall_of_a_sample(spark):
    _, df = points(spark, 300, 5)
    graph, recall = Forest(df, levels=2, seed=1).search(8, 20, sample=30, k_list=[1, 8])
    got = dict(recall.collect())
    assert got[1] == 1.0 and got[8] > 0.9 and graph.count() == 8 * 300


def test_query_search_of_other_rows(spark):
    x, df = points(spark, 400, 5)
    got = table(Forest(df.filter("id >= 40"), levels=2, seed=3).query_search(df.filter("id < 40"), 5, 6))
    want = brute(x[40:], x[:40], 5, np.arange(40, 400))
    hits = sum(len({n for n, _ in got[i]} & {n for n, _ in want[i]}) for i in range(40))
    assert len(got) == 40 and hits / 200 > 0.85


def test_overlap_widens_leaves(spark):
    x, df = points(spark, 120, 3)
    ordered = tree.tree_order(tree.assign_leaves(tree.project_dense(df, make_directions(3, 3, 1)), 3)).join(df, "id")
    narrow, wide = table(search.leaf_knn_overlap(ordered, 4, 0)), table(search.leaf_knn_overlap(ordered, 4, 120))
    leafwise = table(search.leaf_knn(ordered, 4))
    assert [narrow[i] for i in range(120)] == [[(n, pytest.approx(v)) for n, v in leafwise[i]] for i in range(120)]
    assert [wide[i] for i in range(120)] == [[(n, pytest.approx(v)) for n, v in rows] for rows in brute(x, x, 4)]


# ---- merging, metrics, movement ----


def neighbours(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, neighbor_id long, dist double")


def test_merge(spark):
    a = neighbours(spark, [(0, 1, 5, 0.1), (0, 2, 6, 0.3), (1, 1, 1, 0.0)])
    b = neighbours(spark, [(0, 1, 6, 0.2), (0, 2, 7, 0.2), (0, 3, 5, 0.1)])
    assert table(merge.merge_neighbors(a, b, k=3)) == {0: [(5, 0.1), (6, 0.2), (7, 0.2)], 1: [(1, 0.0)]}
    assert table(merge.merge_neighbors(a, a, k=2)) == table(a)
    assert sorted(map(str, merge.unnest(merge.nest(a)).collect())) == sorted(map(str, a.collect()))
    assert merge.first_columns(a, 1).count() == 2
    nan = spark.createDataFrame([(0, [float("nan"), 2.0, 1.0, 1.0])], DENSE)
    assert [r.pos for r in merge.sort_rows(nan, "embedding").orderBy("rank").collect()] == [2, 3, 1, 0]


def test_metrics(spark):
    truth = neighbours(spark, [(0, 1, 0, 0.0), (0, 2, 1, 1.0), (1, 1, 1, 0.0), (1, 2, 0, 2.0)])
    approx = neighbours(spark, [(0, 1, 0, 0.0), (0, 2, 2, 1.5), (1, 1, 1, 0.0), (1, 2, 0, 2.0)])
    one = lambda df: df.first()[0]
    assert one(metrics.recall_distance(truth, approx)) == one(metrics.recall_ids(truth, approx)) == 0.75
    assert one(metrics.kth_error(truth, approx)) == 0.25 and one(metrics.mean_sim(approx)) == 0.875
    assert one(metrics.miss_count(truth, approx)) == one(metrics.miss_count_tolerance(truth, approx)) == 1
    assert one(metrics.strict_match(truth, approx)) == 0.5
    assert one(metrics.frobenius_error(truth, approx)) == pytest.approx(0.5 / 5**0.5)
    assert dict(metrics.recall_at_k(truth, approx, [1, 2]).collect()) == {1: 1.0, 2: 0.75}
    assert one(metrics.recall_ids(truth, approx.filter("query_id = 0"))) == 0.25
    assert metrics.check_accuracy(truth, approx).columns == ["recall", "rel_err", "mean_sim"]


def test_ranks_of_a_hot_value(spark):
    rows = [(i, 0 if i % 3 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(6)
    got = {r.id: r["rank"] for r in exchange.global_rank(df, [], ["v", "id"]).collect()}
    assert got == {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    sums = {r.id: r["prefix"] for r in sparse.prefix_sums(df, "id", "v").collect()}
    total = 0
    for i, v in rows:
        assert sums[i] == total
        total += v


def test_expressions(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0], [0.0, 0.0])], "id int, a array<float>, b array<float>")
    r = df.select(vectors.sqnorm("a"), vectors.norm("a"), vectors.dist("a", "b"), vectors.dot("a", "a"), vectors.normalize("a"), vectors.normalize("b"), vectors.clamp(F.lit(-1e-12)), vectors.project("a", [1, 0])).first()
    assert list(r) == [25, 5, 5, 25, [0.6, 0.8], [0, 0], 0, 3]
    assert vectors.validate(df, "a", 2) == 2
    with pytest.raises(ValueError):
        vectors.validate(df, "a", 3)


def test_records(spark, tmp_path):
    rec, prof = Recorder(), Profiler()
    rec.push("recall", 0.5)
    rec.push("recall", 0.75)
    with prof.region("a"), prof.region("b"):
        pass
    rec.write(spark, str(tmp_path / "r"))
    prof.write(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in rec.frame(spark).collect()] == [(0, "recall", 0.5), (1, "recall", 0.75)]
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2 and set(prof.seconds) == {"a", "b"} and "recall" in str(rec)
    prof.reset()
    assert str(prof) == ""
