"""Nulls, NaN, repeated ids, empty tables, clashing columns, and sessions without a shared folder."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.functions import vectors
from vicinage.operators import search
from vicinage.operators.forest import Forest
from vicinage.operators.monitor import SearchError
from vicinage import storage

from .conftest import ROOT

DENSE = "id long, embedding array<double>, leaf_id long, rank string, dist string"
SPARSE = "id long, col int, val double, rank string"


def rows(n=64, d=64):
    x = np.random.default_rng(3).standard_normal((n, d))
    good = [(i, v.tolist(), i % 4, "r", "d") for i, v in enumerate(x)]
    nan, inf, hole = [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [0.0] * (d - 1)
    bad = [(None, x[0].tolist(), 0, None, None), (900, None, 1, None, None), (901, nan, 2, None, None), (902, inf, 3, None, None), (903, hole, 0, None, None)]
    return good, bad


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "neighbor_id", F.round("dist", 9)).collect())


@pytest.fixture(scope="module")
def tables(spark):
    good, bad = rows()
    return spark.createDataFrame(good, DENSE).coalesce(2), spark.createDataFrame(good[:20] + bad + good[20:], DENSE).coalesce(2)


def test_unusable_rows_take_no_part(tables):
    clean, mixed = tables
    for engine in ("blocks", "sql"):
        assert got(search.exact_knn(mixed, mixed, 3, engine=engine)) == got(search.exact_knn(clean, clean, 3, engine=engine))
    for engine in ("arrow", "sql"):
        assert got(search.leaf_knn(mixed, 3, engine=engine)) == got(search.leaf_knn(clean, 3, engine=engine))
    one, two = Forest(clean, levels=2, seed=1), Forest(mixed, levels=2, seed=1)
    assert two.n == 64 and got(two.all_search(3, 2, batch=2)) == got(one.all_search(3, 2, batch=2))
    assert got(two.query_search(mixed, 2, 1)) == got(one.query_search(clean, 2, 1))
    assert mixed.filter(vectors.usable("embedding")).count() == 65


def test_one_null_among_as_many_rows_as_components_shifts_nothing(spark):
    good, _ = rows()
    with_null = spark.createDataFrame([(i, None if i == 5 else v, *r) for i, v, *r in good], DENSE).coalesce(1)
    without = spark.createDataFrame([r for r in good if r[0] != 5], DENSE).coalesce(1)
    assert got(search.exact_knn(with_null, with_null, 2)) == got(search.exact_knn(without, without, 2))
    import pyarrow as pa

    for bad in ([[1.0, 2.0], None], [[1.0, None], [1.0, 2.0]], [[1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(ValueError):
            vectors.matrix(pa.array(bad))
    assert vectors.matrix(pa.array([[9.0, 9.0], [1.0, 2.0]]).slice(1)).tolist() == [[1.0, 2.0]]


def test_repeated_ids(spark):
    table = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0])], "id long, embedding array<double>")
    found = [(r.rank, r.neighbor_id) for r in search.exact_knn(table.filter("id = 2"), table, 4).orderBy("rank").collect()]
    assert found == [(1, 2), (2, 1), (3, 1), (4, 3)]
    graph = Forest(table, levels=0).all_search(4, 1).filter("query_id = 2").orderBy("rank").collect()
    assert [(r.rank, r.neighbor_id) for r in graph] == [(1, 2), (2, 1), (3, 3)]


def test_empty_tables(spark, tables):
    nothing, clean = spark.createDataFrame([], DENSE), tables[0]
    for engine in ("blocks", "sql"):
        assert got(search.exact_knn(nothing, clean, 2, engine=engine)) == [] == got(search.exact_knn(clean, nothing, 2, engine=engine))
    assert search.pairwise_sqdist(nothing, clean).collect() == [] == got(search.leaf_knn(nothing, 2))
    with pytest.raises(SearchError):
        Forest(nothing)
    entries = spark.createDataFrame([], SPARSE)
    assert got(search.exact_knn_sparse(entries, entries, 2)) == []


def test_sparse_entries_that_are_not_numbers(spark):
    own = [(0, 1, 2.0, "r"), (1, 1, 1.0, "r"), (1, 7, 3.0, "r"), (2, 9, 1.0, "r")]
    bad = [(0, None, 1.0, "r"), (None, 1, 1.0, "r"), (2, 1, None, "r"), (2, 1, float("nan"), "r")]
    clean, mixed = (spark.createDataFrame(x, SPARSE) for x in (own, own + bad))
    ids = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "id long")
    a, b = (got(search.exact_knn_sparse(x, x, 3, query_ids=ids, point_ids=ids)) for x in (clean, mixed))
    assert a == b and len(a) == 12 and (3, 1, 3, 0.0) in a and (3, 2, 2, 1.0) in a
    chunks = [F.col("id") == 1, F.col("id") != 1]
    assert got(search.exact_knn_sparse_chunked(clean, clean, 2, chunks)) == got(search.exact_knn_sparse(clean, clean, 2))


def test_wide_sparse_products(monkeypatch):
    monkeypatch.setattr(search, "COLUMNS", 3)
    monkeypatch.setattr(search, "PRODUCTS", 5)
    rng = np.random.default_rng(0)
    for n, m, width, share in ((30, 40, 50, 0.3), (30, 40, 3000, 0.01), (5, 7, 10, 0.0)):
        a, b = (rng.random((k, width)) * (rng.random((k, width)) < share) for k in (n, m))
        p, q = (search.Entries((x != 0).sum(1), np.nonzero(x)[1], x[x != 0]) for x in (a, b))
        assert np.allclose(search.sparse_dots(p, q), a @ b.T) and np.allclose(search.sparse_dots(p.part(2, 5), q), a[2:5] @ b.T)


def test_tables_are_written_without_checksum_files(spark):
    path = storage.fresh_path(spark, "plain")
    back = storage.write(spark.range(9).withColumn("x", F.col("id") * 2), path)
    assert sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(9)] and back.schema == spark.read.parquet(path).schema
    names = os.listdir(storage.local_path(path))
    assert names and all(n.endswith(".parquet") for n in names)


def test_scratch_tables_are_deleted(spark):
    kept = storage.materialize(spark.range(5), "kept")
    out = storage.fresh_path(spark, "out")
    with storage.scratch(spark):
        part = storage.materialize(spark.range(3), "part")
        folder = part.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        part.write.parquet(out)
    assert not os.path.exists(folder) and spark.read.parquet(out).count() == 3 and kept.count() == 5


ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from vicinage import storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
one, two = storage.materialize(spark.range(7), "x"), storage.fresh_path(spark, "y")
assert one.count() == 7 and storage.shared_dir(spark) == storage.shared_dir(spark) and two.startswith(storage.session_dir(spark))
print("folder", storage.local_path(storage.shared_dir(spark)))
storage.clean(spark)
spark.stop()
"""


def test_a_session_that_names_no_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", ALONE.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    folder = run.stdout.split("folder ")[1].split()[0]
    assert not os.path.exists(folder)


def test_a_cluster_must_name_a_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
