"""Plans of pairs and products of packed rows, against brute force, at sizes that make several rounds and cells."""

import numpy as np
import pytest

from vicinage.functions import sparse, vectors
from vicinage.operators import products, search, twins




def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


@pytest.mark.parametrize("width", [1, 64])
def test_pairs_of_the_sql_engine_are_bounded_in_rounds(spark, monkeypatch, width):
    monkeypatch.setattr(search, "FIRST", 2)
    monkeypatch.setattr(search, "GROWTH", 3)
    monkeypatch.setattr(search, "PAIR_ROWS", 50)
    monkeypatch.setattr(search, "PLAIN_WIDTH", width)
    x = np.round(4 * np.random.default_rng(9).standard_normal((300, 5))) / 4  # distances are exact, some tie
    x[250:] = x[:50]
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for self_ in (True, False):
        found = search.exact_knn(points, points, 4, engine="sql", include_self=self_)
        text = plan(found)
        assert "NestedLoop" not in text and "Cartesian" not in text and ("zip_with" not in text) == (width > 5)
        got = {(r.query_id, r.rank): (r.neighbor_id, r.dist) for r in found.collect()}
        for i in range(300):
            near = [j for j in np.lexsort((np.arange(300), d[i])) if self_ or i != j][:4]
            assert [got[i, r + 1][0] for r in range(4)] == near and np.allclose([got[i, r + 1][1] for r in range(4)], d[i, near])
        assert len(got) == 1200
    with pytest.raises(ValueError, match="components"):
        search.exact_knn(points, spark.createDataFrame([(1, [0.0] * 4)], "id long, embedding array<double>"), 2, engine="sql")


def test_leaves_of_the_sql_engine_are_bounded_in_rounds(spark, monkeypatch):
    for name, value in (("FIRST", 2), ("GROWTH", 3), ("PAIR_ROWS", 30)):
        monkeypatch.setattr(search, name, value)
    x = np.round(4 * np.random.default_rng(4).standard_normal((260, 5))) / 4
    rows = [(t, int(i) % (2 + t), int(i), v.tolist()) for t in (0, 1) for i, v in enumerate(x)]
    members = spark.createDataFrame(rows, "tree int, leaf_id long, id long, embedding array<double>")
    found = search.leaf_knn(members, 4, group=("tree", "leaf_id"), engine="sql")
    assert "zip_with" not in plan(found)
    got = {(r.query_id, r.rank): (r.neighbor_id, r.dist) for r in found.collect()}
    d, ids = ((x[:, None] - x[None]) ** 2).sum(2), np.arange(260)
    for i in ids:
        near = [j for j in np.lexsort((ids, d[i])) if j % 2 == i % 2 or j % 3 == i % 3][:4]
        assert [got[i, r + 1] for r in range(4)] == [(j, d[i, j]) for j in near]
    assert len(got) == 1040


def test_overlapping_leaves_meet_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 40)
    monkeypatch.setattr(search, "POINT_BLOCK", 70)
    x = np.round(4 * np.random.default_rng(6).standard_normal((300, 5))) / 4
    leaf, overlap = np.searchsorted([110, 130, 250], np.arange(300), side="right"), 15  # positions are not ids
    rows = [(n, int(leaf[n]), int(i), x[i].tolist()) for n, i in enumerate(np.random.default_rng(7).permutation(300))]
    found = search.leaf_knn_overlap(spark.createDataFrame(rows, "pos long, leaf_id long, id long, embedding array<double>"), 4, overlap)
    assert "zip_with" not in plan(found)
    got = {(r.query_id, r.rank): (r.neighbor_id, r.dist) for r in found.collect()}
    for n, l, i, _ in rows:
        own = np.flatnonzero(leaf == l)
        reach = [r[2] for r in rows[max(0, own[0] - overlap) : own[-1] + overlap + 1]]
        near = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in reach)[:4]
        assert [got[i, r + 1] for r in range(4)] == [(j, d) for d, j in near]
    assert len(got) == 1200


ENTRIES = "row long, col int, val double"


def sums(left, right, group=()):
    """(group, i, j) -> val, by all pairs of entries; a sum without a value is null."""
    out = {}
    for *g, i, k, a in left:
        for *h, l, j, b in right:
            if g == h and k is not None and k == l:
                out.setdefault((*g, i, j), []).append(None if a is None or b is None else a * b)
    return {at: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for at, v in out.items()}


def same(got, want):
    assert set(got) == set(want)
    for at, v in want.items():
        assert (got[at] is None) == (v is None) and (v is None or got[at] == pytest.approx(v, abs=1e-9, nan_ok=True)), at


def some(n, width, share, odd=True):
    rng = np.random.default_rng(n)
    out = [(i, c, float(rng.integers(-3, 4)) / 2) for i in range(n) for c in range(width) if rng.random() < share]
    return out + [(3, 1, 0.5), (None, 2, 1.0), (4, None, 1.0), (5, 0, float("nan")), (6, 2, float("inf")), (n + 5, 1, None)] * odd


@pytest.mark.parametrize("rows, share, crowded", [(40, 0.5, True), (120, 0.002, False)])
def test_products_in_cells_and_by_joins(spark, monkeypatch, rows, share, crowded):
    monkeypatch.setattr(products, "ROWS", 7)
    monkeypatch.setattr(products, "SIDE", 2)
    own = some(rows, 5 if crowded else 400, share, odd=crowded)
    back = [(c, r, v) for r, c, v in own]
    found = sparse.multiply(spark.createDataFrame(own, ENTRIES), spark.createDataFrame(back, "row int, col long, val double"))
    assert ("MapInArrow" in plan(found)) == crowded and dict(found.dtypes) == {"i": "bigint", "j": "bigint", "val": "double"}
    rows_ = found.collect()
    same({(r.i, r.j): r.val for r in rows_}, sums(own, back))
    assert len(rows_) == len(sums(own, back))


def test_rounding_is_that_of_sql(spark):
    x = [0.5e-6, -0.5e-6, 2.5, -2.5e-7, 1.0000005, 1e18 + 0.1, float("inf"), -0.0, 123456.1234565]
    got = vectors.round_half_up(np.array(x), 6)
    assert got.tolist() == [1e-6, -1e-6, 2.5, 0.0, 1.000001, 1e18, float("inf"), 0.0, 123456.123457] and not np.signbit(got[[3, 7]]).any()
    assert np.isnan(vectors.round_half_up(np.array([np.nan]), 6)).all()


@pytest.mark.parametrize("rows, share, crowded", [(40, 0.5, True), (120, 0.002, False)])
def test_gram_mirrors_tiles(spark, monkeypatch, rows, share, crowded):
    monkeypatch.setattr(products, "ROWS", 7)
    monkeypatch.setattr(products, "SIDE", 2)
    own = some(rows, 5 if crowded else 400, share, odd=crowded) + [(None, 3, 2.0)]
    found = sparse.gram(spark.createDataFrame(own, ENTRIES))
    assert ("MapInArrow" in plan(found)) == crowded
    rows_ = found.collect()
    same({(r.i, r.j): r.val for r in rows_}, sums(own, [(c, r, v) for r, c, v in own]))
    assert len(rows_) == len({(r.i, r.j) for r in rows_})


@pytest.mark.parametrize("rows, share, crowded", [(40, 0.5, True), (120, 0.002, False)])
def test_products_of_diagonal_blocks(spark, monkeypatch, rows, share, crowded):
    monkeypatch.setattr(products, "ROWS", 7)
    monkeypatch.setattr(products, "SIDE", 2)
    own = [(b, *e) for b, n in ((0, rows), (1, 9), (4, rows // 2)) for e in some(n, 5 if crowded else 400, share, odd=crowded)]
    own += [(7, 1, 1, 1.0), (None, 1, 1, 1.0)] if crowded else []
    back = [(b, c, r, v) for b, r, c, v in own if b != 7]
    own, back = ([e for e in x if e[0] is not None] + [(None, 1, 1, 1.0)] for x in (own, back))
    schema = "block int, " + ENTRIES
    found = sparse.multiply_blocks(spark.createDataFrame(own, schema), spark.createDataFrame(back, schema.replace("col int", "col long")))
    assert ("MapInArrow" in plan(found)) == crowded
    rows_ = found.collect()
    want = {at: v for at, v in sums(own, back, ("block",)).items() if at[0] is not None}
    same({(r.block, r.i, r.j): r.val for r in rows_}, want)
    assert len(rows_) == len(want)


def test_products_on_the_whole_grid(spark, monkeypatch):
    monkeypatch.setattr(products, "ROWS", 7)
    monkeypatch.setattr(products, "SIDE", 2)
    own, other = (some(n, 5, 0.3, odd=False) for n in (30, 20))
    q, r = (spark.createDataFrame(x, "id long, col int, val double") for x in (own + [(99, 1, 1.0)], other))  # 99 is not asked for
    q_ids, r_ids = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([*range(35), 3, None], range(25)))
    found = sparse.inner_whole(q, r, q_ids, r_ids)
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    rows_ = found.collect()
    want = sums(own, [(c, j, v) for j, c, v in other])
    assert sorted((str(r.i), r.j) for r in rows_) == sorted((str(i), j) for i in [*range(35), 3, None] for j in range(25))
    assert all(r.val == pytest.approx(want.get((r.i, r.j), 0.0)) for r in rows_)


def test_distance_matrix_by_products_keeps_small_distances(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 70)
    monkeypatch.setattr(search, "POINT_BLOCK", 50)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 6)) + 1e6  # norms that swallow the distances
    x[100:] = x[:100] + 1e-3
    x[7] = x[3]
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    want = ((x[:, None] - x[None]) ** 2).sum(2)
    for digits, near in ((None, 1e-12), (6, 0.6e-6)):
        got = search.pairwise_sqdist(points, points, digits=digits).toPandas()
        assert len(got) == 40000 == len(set(zip(got.i, got.j))) and (got.dist >= 0).all()
        assert abs(got.dist.to_numpy() - want[got.i, got.j]).max() < near
    assert (got.dist == vectors.round_half_up(got.dist.to_numpy(), 6)).all()
    y = rng.standard_normal((30, 4))
    assert np.allclose(search.distances(y, y + 3), ((y[:, None] - y[None] - 3) ** 2).sum(2), rtol=1e-12)


@pytest.mark.parametrize("tile, strip, run", [(50, 32, 64), (30, 7, 8), (1024, 32, 64)])
def test_own_distances_are_made_once_and_mirrored(spark, monkeypatch, tile, strip, run):
    monkeypatch.setattr(search, "TILE", tile)
    monkeypatch.setattr(search, "TILES", 2)
    monkeypatch.setattr(search, "STRIP", strip)
    monkeypatch.setattr(twins, "RUN", run)
    twins._twice_all.cache_clear()
    x = np.random.default_rng(3).standard_normal((230, 6))
    ids = np.r_[np.arange(200), np.arange(30)]  # some stand for two rows
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(None, [0.0] * 6), (900, [float("nan")] * 6)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    got = search.pairwise_sqdist(points, points).toPandas()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = sorted(zip(np.repeat(ids, 230), np.tile(ids, 230), d.ravel()))
    got = sorted(zip(got.i, got.j, got.dist))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-12)
    other = points.filter("id < 20")
    assert search.pairwise_sqdist(other, points).count() == 40 * 230
    mixed = points.unionByName(spark.createDataFrame([(1, [0.0] * 4)], points.schema))
    with pytest.raises(Exception, match="length|components"):
        search.pairwise_sqdist(mixed, mixed).collect()
    twins._twice_all.cache_clear()


@pytest.mark.parametrize("share", [0.0, 0.6, 0.98, 1.0])
@pytest.mark.parametrize("shape", [(32, 1024), (5, 70), (1, 1), (40, 7)])
def test_entries_and_their_mirror_images(share, shape):
    there = np.random.default_rng(1).random(shape) < share
    place, image = twins.twice(there)
    assert sorted(place[~image]) == sorted(place[image]) == list(np.flatnonzero(there))


def test_product_with_itself_on_the_whole_grid(spark, monkeypatch):
    monkeypatch.setattr(products, "ROWS", 7)
    monkeypatch.setattr(products, "SIDE", 2)
    own = some(30, 5, 0.3, odd=False)
    points = spark.createDataFrame(own + [(99, 1, 1.0)], "id long, col int, val double")  # 99 is not asked for
    asked = [*range(35), 3, None]
    ids = spark.createDataFrame([(i,) for i in asked], "id long")
    rows_ = sparse.inner_whole(points, points, ids, ids).collect()
    want = sums(own, [(c, j, v) for j, c, v in own])
    assert sorted((str(r.i), str(r.j)) for r in rows_) == sorted((str(i), str(j)) for i in asked for j in asked)
    assert all(r.val == pytest.approx(want.get((r.i, r.j), 0.0)) for r in rows_)


@pytest.fixture(scope="module")
def vectors_of_1500(spark, tmp_path_factory):
    x = np.random.default_rng(2).standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = str(tmp_path_factory.mktemp("pairs"))
    spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name, most", [("pairwise_sqdist", 5.0), ("spgemm_dense", 4.0), ("gram_symmetric", 4.2), ("spgemm", 4.2)])
def test_results_of_all_pairs_are_short_on_disk(spark, monkeypatch, vectors_of_1500, tmp_path, name, most):
    """Values that are written twice near each other, and in a dictionary: before, over 8 bytes a pair."""
    from vicinage.plans import queries as Q

    monkeypatch.setattr(products, "GRAIN", 1)
    monkeypatch.setattr(search, "GRAIN", 1)
    Q.QUERIES[name](spark, vectors_of_1500).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 2_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) / rows < most
