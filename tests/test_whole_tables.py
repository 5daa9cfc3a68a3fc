"""The queries over whole tables, against brute force."""

import numpy as np
import pytest

from vicinage.plans import queries as Q


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """640 vectors, some with ids that leave gaps, so that no first 50, 100, 200 or 500 ids are all."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((640, Q.WIDTH))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.r_[np.arange(600), 700 + 3 * np.arange(40)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, ids, x.astype(float)


def run(spark, table, name):
    return Q.QUERIES[name](spark, table[0]).toPandas()


def brute(table, left=None, self_=True):
    _, ids, x = table
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = {}
    for i, q in enumerate(ids):
        near = [j for j in np.lexsort((ids, d[i])) if (left is None or left[j]) and (self_ or i != j)][: Q.K]
        out.update({(int(q), r + 1): (int(ids[j]), d[i, j]) for r, j in enumerate(near)})
    return out


@pytest.mark.parametrize("name", ["exact_knn", "exact_knn_euclidean", "exact_knn_sql", "exact_knn_without_self", "exact_knn_chunked", "local_exact", "redistribute", "read_truth"])
def test_neighbours_of_every_row(spark, table, name):
    want = brute(table, table[1] % 4 == 1 if name == "local_exact" else None, name != "exact_knn_without_self")
    if name == "read_truth":  # the format has a line a query and no ids of them
        place = {int(i): n for n, i in enumerate(table[1])}
        want = {(place[q], r): x for (q, r), x in want.items()}
    got = {(r.query_id, r.rank): (r.neighbor_id, r.dist) for r in run(spark, table, name).itertuples()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - (d**0.5 if name == "exact_knn_euclidean" else d)) < 2e-6 for k, (_, d) in want.items())


def test_whole_products(spark, table):
    _, ids, x = table
    place = {int(i): n for n, i in enumerate(ids)}
    kept = np.where(abs(x) > 0.15, x, 0.0)
    shared = (kept != 0).astype(int) @ (kept != 0).T > 0
    for name, column, value, there in (("pairwise_sqdist", "dist", ((x[:, None] - x[None]) ** 2).sum(2), np.ones_like(shared)), ("spgemm", "val", kept @ kept.T, shared), ("spgemm_dense", "val", kept @ kept.T, np.ones_like(shared))):
        got = run(spark, table, name)
        at = got.i.map(place).to_numpy(), got.j.map(place).to_numpy()
        assert len(got) == there.sum() and there[at].all() and len(set(zip(*at))) == len(got), name
        assert abs(got[column].to_numpy() - value[at]).max() < 2e-6, name
    got = run(spark, table, "permute_rows").sort_values("pos")
    assert list(got.pos) == list(range(len(ids))) and abs(got["first"].to_numpy() - x[::-1, 0]).max() < 2e-6


def test_metrics_of_every_row(spark, table):
    want, points = brute(table), Q.dense(spark, table[0])
    forest = Q.small_forest(points, fused_rows=0)
    approx = {(r.query_id, r.rank): (r.neighbor_id, r.dist) for r in forest.all_search(Q.K, 2).collect()}
    share = lambda hit: sum(map(hit, want)) / len(want)
    nearest = {q: {want[q, r][0] for r in range(1, Q.K + 1)} for q, _ in want}
    value = lambda name: run(spark, table, name).iloc[0, 0]
    assert value("recall_ids") == pytest.approx(share(lambda k: k in approx and approx[k][0] in nearest[k[0]]))
    assert value("recall_distance") == pytest.approx(share(lambda k: k in approx and approx[k][1] <= want[k[0], Q.K][1] + 1e-9))
    assert value("mean_sim") == pytest.approx(np.mean([d for _, d in approx.values()]), abs=2e-6)
    gap = sum((approx[k][1] - want[k][1]) ** 2 for k in want) ** 0.5
    assert value("frob_error") == pytest.approx(gap / sum(d * d for _, d in want.values()) ** 0.5, abs=2e-6)
    far = {q: want[q, Q.K][1] for q, _ in want}
    assert value("rel_err") == pytest.approx(np.mean([abs(approx[q, Q.K][1] - f) / f for q, f in far.items()]), abs=2e-6)
    assert len(run(spark, table, "row_mean_sim")) == len(far)
    assert value("miss_count") == sum(d > far[k[0]] * (1 + 1e-6) and n not in nearest[k[0]] for k, (n, d) in approx.items())
    assert value("strict_match") == pytest.approx(np.mean([all(approx[q, r][0] == want[q, r][0] for r in range(1, Q.K + 1)) for q in far]))
