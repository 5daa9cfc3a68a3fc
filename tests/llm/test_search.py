import math

import numpy as np
import pytest

from vicinage.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, `rank` string"


def table(spark, n=300, d=16, seed=0, hot=40):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[:hot] = x[0]  # one common vector: ties
    rows = [(i, x[i].tolist(), 0, "s", "r") for i in range(n)]
    rows += [(900000, None, None, None, None), (900001, [1.0, None] + [0.0] * (d - 2), None, None, None), (900002, [math.nan] * d, None, None, None), (900003, [math.inf] + [0.0] * (d - 1), None, None, None), (900004, [0.0] * d, None, None, None), (None, x[0].tolist(), None, None, None), (900005, [0.5] * (d - 3), None, None, None), (900006, [], None, None, None)]
    rows += [rows[5], rows[n // 2]]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def usable(rows, zero=True):
    out = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    return [r for r in out if zero or r[1].any()]


def pad(v, d):
    return np.pad(v, (0, d - len(v)))


def test_exact_top_k_matches_brute_force(spark):
    rows, frame = table(spark)
    found = topk.exact_top_k(frame, frame.filter("vec_id % 5 = 0"), 10)
    good = usable(rows)
    expected = []
    for q, v in {i: v for i, v in good if i % 5 == 0}.items():
        scores = sorted(((-int((np.floor(1024 * pad(v, 16)) * np.floor(1024 * pad(c, 16))).sum()), i) for i, c in good if i != q))[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, [2e6, 1.0]), (1, [2e6, 1.0]), (2, [2e6, 2.0]), (3, [2e6 - 4, 5.0]), (4, [-2e6, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_top_k(frame, frame.filter("vec_id = 0"), 3).orderBy("rank").collect()]
    ints = [[math.floor(1024 * v) for v in e] for _, e in rows]
    scores = sorted((-sum(a * b for a, b in zip(ints[0], ints[i])), i) for i in (1, 2, 3, 4))[:3]
    assert -scores[0][0] > 2**53
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_waves_and_small_blocks(spark, monkeypatch):
    rows, frame = table(spark)
    whole = sorted(tuple(r) for r in topk.exact_top_k(frame, frame.filter("vec_id % 3 = 0"), 4).collect())
    small = list(topk.waves(topk.vectors(frame.filter("vec_id % 3 = 0"), "vec_id", "embedding"), 16))
    assert all(len(ids) <= 16 for ids, _ in small) and sum(len(ids) for ids, _ in small) == len({r[0] for r in whole})


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    _, frame = table(spark, n=20)
    for search in (topk.exact_top_k, ann.nearest):
        assert search(nothing, nothing, 3).collect() == [] == search(frame, nothing, 3).collect() == search(nothing, frame, 3).collect()


def test_forest_scores_order_and_recall(spark):
    rows, frame = table(spark, n=1500, d=32, hot=60)
    found = ann.nearest(frame, frame.filter("vec_id % 20 = 0"), 20).toPandas()
    good = dict(usable(rows, zero=False))
    recall = []
    for q, group in found.groupby("query_id"):
        v = pad(good[q], 32)
        true = sorted((-float(pad(c, 32) @ v), i) for i, c in good.items() if i != q)
        limit = -true[19][0]
        recall.append((group.score >= limit - 1e-9).sum() / 20)
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21)) and q not in set(group.vec_id) and 900004 not in set(group.vec_id)
        keys = list(zip(-group.score, group.vec_id))
        assert keys == sorted(keys)
        for i, s in zip(group.vec_id, group.score):
            assert s == pytest.approx(float(pad(good[i], 32) @ v), abs=1e-9)
    assert len(recall) == len([i for i in good if i % 20 == 0]) and np.mean(recall) >= 0.9


def test_candidates_are_prefix_matches():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8))
    forest = ann.Forest(np.arange(500), x, trees=6, bits=12)
    codes = np.empty((6, 500), np.uint32)
    np.put_along_axis(codes, forest.order, forest.sorted, axis=1)
    q = x[:20]
    asked = forest.strings(np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((20, 1))]))
    for i, rows in enumerate(forest.candidates(q, 100)):
        for level in range(12, -1, -1):
            match = (codes >> (12 - level)) == (asked[:, i] >> (12 - level))[:, None]
            if match.sum() >= 100:
                assert np.flatnonzero(match.any(0)).tolist() == rows.tolist()
                break


def test_fewer_candidates_than_asked_for(spark):
    """All candidates are answers, however low they score."""
    rows = [(0, [4e6, 4e6]), (1, [-4e8, -4e8]), (2, [-3e11, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_top_k(frame, frame.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2)] and got[1][3] < -(2**62)


def test_equal_rows_get_equal_scores(spark):
    """Ties go to the smaller id wherever the rows lie."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x[100:160] = x[100]
    rows = [(int(i), x[i].tolist()) for i in rng.permutation(400)]
    answers = []
    for parts in (1, 3, 7):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        found = ann.nearest(frame, frame.filter("vec_id >= 100 AND vec_id < 130"), 20).collect()
        assert all(r.vec_id in range(100, 160) for r in found)
        by = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q, rows_ in by.items():
            assert [i for i, _ in rows_] == [i for i in range(100, 121) if i != q][:20] and len({s for _, s in rows_}) == 1
        answers.append(by)
    assert answers[0] == answers[1] == answers[2]


def test_clustered_vectors_need_few_candidates():
    """The stop is measured: with structure it comes early and keeps the recall."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    own = rng.integers(0, 40, 8000)
    x = centres[own] + 0.1 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(np.arange(8000), x)
    ids = np.arange(0, 8000, 100)
    enough = forest.enough(ids, x[ids], 20)
    seen, right = [], []
    for i, rows in zip(ids, forest.candidates(x[ids], enough)):
        score = x @ x[i]
        score[i] = -np.inf
        right.append(np.isin(np.argsort(-score)[:20], rows).mean())
        seen.append(len(rows) / 8000)
    assert np.mean(right) >= 0.95 and np.mean(seen) < 0.2
