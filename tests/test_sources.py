import struct

import numpy as np
import pytest

from vicinage.sources import generators, readers, writers


def dense(df):
    rows = df.orderBy("id").collect()
    return np.array([r.embedding for r in rows]), [r.id for r in rows]


def entries(df):
    return sorted((r.id, r.col, round(r.val, 5)) for r in df.collect())


SPARSE = [(0, 0, 1.5), (0, 3, -2.0), (2, 1, 0.25), (3, 4, 7.0)]


def test_csr_round_trips(spark, tmp_path):
    points = spark.createDataFrame(SPARSE, readers.SPARSE)
    writers.write_csr_binary(points, str(tmp_path / "a.bin"), 4, 5)
    writers.write_csr_text(points, str(tmp_path / "a.txt"), 4, 5)
    assert entries(readers.read_csr_binary(spark, str(tmp_path / "a.bin"))) == SPARSE
    assert entries(readers.read_csr_text(spark, str(tmp_path / "a.txt"))) == SPARSE
    starts, cols, vals = writers.csr_arrays(points, 4)
    for name, x in (("s", starts), ("c", cols), ("v", vals)):
        x.tofile(tmp_path / name)
    assert entries(readers.read_csr_split(spark, *(str(tmp_path / n) for n in "scv"))) == SPARSE
    writers.write_sparse(points, str(tmp_path / "q"))
    assert entries(spark.read.parquet(str(tmp_path / "q"))) == SPARSE
    rows = spark.createDataFrame([(0, [0, 3], [1.5, -2.0]), (2, [1], [0.25]), (3, [4], [7.0])], "id long, c array<int>, v array<double>")
    assert entries(readers.read_csr_rows(rows, "id", "c", "v")) == SPARSE


def test_svm(spark, tmp_path):
    (tmp_path / "a.svm").write_text("1 1:1.5 4:-2\n\n0\n")
    (tmp_path / "b.svm").write_text("-1 2:0.25  \n1 5:7\n")
    paths = [str(tmp_path / "a.svm"), str(tmp_path / "b.svm")]
    assert entries(readers.read_svm(spark, paths, 5)) == SPARSE
    assert sorted(map(tuple, readers.svm_ids(spark, paths).collect())) == [(0, 1.0), (1, 0.0), (2, -1.0), (3, 1.0)]
    assert {r.label for r in readers.read_svm(spark, paths, labels=True).collect()} == {1.0, -1.0}
    with pytest.raises(Exception, match="beyond the width"):
        readers.read_svm(spark, paths, 4).collect()
    writers.write_svm(spark.createDataFrame(SPARSE, readers.SPARSE), str(tmp_path / "out"))
    assert len(entries(readers.read_svm(spark, str(tmp_path / "out")))) == 4


def test_vector_records(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 256, (50, 6))
    with open(tmp_path / "a.fvecs", "wb") as f, open(tmp_path / "a.bvecs", "wb") as b:
        for row in x:
            f.write(struct.pack("<i", 6) + row.astype("<f4").tobytes())
            b.write(struct.pack("<i", 6) + row.astype("u1").tobytes())
    got, ids = dense(readers.read_fvecs(spark, str(tmp_path / "a.fvecs"), 6))
    assert (got == x).all() and ids == list(range(50))
    got, ids = dense(readers.read_bvecs(spark, str(tmp_path / "a.bvecs"), 6, 10, 5))
    assert (got == x[10:15]).all() and ids == list(range(10, 15))
    with pytest.raises(Exception, match="not of width"):
        readers.read_fvecs(spark, str(tmp_path / "a.fvecs"), 13).collect()


def test_idx_and_npy(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 256, (7, 2, 3)).astype("u1")
    (tmp_path / "a.idx").write_bytes(b"\0\0\x08\x03" + struct.pack(">3i", 7, 2, 3) + x.tobytes())
    assert (dense(readers.read_idx(spark, str(tmp_path / "a.idx")))[0] == x.reshape(7, 6)).all()
    np.save(tmp_path / "s0.npy", x[:4].reshape(4, 6))
    np.save(tmp_path / "s1.npy", x[4:].reshape(3, 6))
    got, ids = dense(readers.read_npy(spark, [str(tmp_path / "s0.npy"), str(tmp_path / "s1.npy")], 6))
    assert (got == x.reshape(7, 6)[:6]).all() and ids == list(range(6))


def test_truth(spark, tmp_path):
    rows = [(0, 1, 0, 0.0), (0, 2, 4, 1.5), (1, 1, 1, 0.0), (1, 2, 0, 1.25)]
    table = spark.createDataFrame(rows, readers.TRUTH)
    writers.write_matrix_text(table, str(tmp_path / "t"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    (tmp_path / "truth.txt").write_text(text)
    assert text.split("\n")[0] == "2 2"
    assert sorted(map(tuple, readers.read_truth_text(spark, str(tmp_path / "truth.txt")).collect())) == rows
    np.save(tmp_path / "i.npy", np.array([[0, 4], [1, 0]]))
    np.save(tmp_path / "d.npy", np.array([[0.0, 1.5], [0.0, 1.25]]))
    assert sorted(map(tuple, readers.read_truth_npy(spark, str(tmp_path / "i.npy"), str(tmp_path / "d.npy")).collect())) == rows
    writers.write_graph(table, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4


def test_cache_is_written_once(spark, tmp_path):
    made = []
    for _ in range(2):
        df = readers.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3))
        assert df.count() == 3
    assert made == [1]


def test_hdf5_says_what_is_missing(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(NotImplementedError, match="h5py"):
            readers.read_hdf5(spark, "x.h5")


def test_generators_repeat_and_look_as_asked(spark):
    for make in (generators.gaussian, generators.uniform, generators.spheres):
        a, ids = dense(make(spark, 5000, 12))
        b, _ = dense(make(spark, 5000, 12))
        c, _ = dense(make(spark, 5000, 12, seed=11))
        assert (a == b).all() and (a != c).any() and ids == list(range(5000)) and a.shape == (5000, 12)
    x, _ = dense(generators.gaussian(spark, 5000, 12))
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02
    s = generators.sparse_rows(spark, 2000, 50, 6).toPandas()
    assert not s.duplicated(["id", "col"]).any() and 5.5 < len(s) / 2000 < 6.5 and s.col.max() < 50
    assert generators.sparse_rows(spark, 100, 50, 6, fixed=True).count() == 600
    d = generators.sparse_density(spark, 500, 100, 0.1).toPandas()
    assert 0.08 < len(d) / 50_000 < 0.12 and d.val.max() < 0.1
    points, queries = generators.with_queries(generators.uniform(spark, 100, 3), 10)
    assert (points.count(), queries.count()) == (100, 10)
