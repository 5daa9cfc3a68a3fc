"""Readers of vector files. Dense rows come as (id, embedding), sparse ones as (id, col, val).

Record formats (fvecs, bvecs) split at record borders, so a file of any size is read in parallel; the
whole-file formats are read a file a row, so large sets should be many files or Parquet.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE, SPARSE = "id long, embedding array<float>", "id long, col int, val float"


def read_dense(spark: SparkSession, path: str, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """Parquet rows as (id, embedding) of floats."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("embedding"))


def read_csr_rows(rows: DataFrame, id_col: str, columns: str, values: str) -> DataFrame:
    """Rows holding an array of columns and one of values, as sparse entries."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.explode(F.arrays_zip(F.col(columns).alias("col"), F.col(values).alias("val"))).alias("x")).select("id", F.col("x.col").cast("int").alias("col"), F.col("x.val").cast("float").alias("val"))


def read_svm(spark: SparkSession, paths: str | list[str], width: int | None = None, labels: bool = False) -> DataFrame:
    """LibSVM text, `label col:val ...` with columns from 1, files one after another (globs allowed).

    Lines become rows numbered from 0 in (file, line) order; a label column is kept on request. A
    column beyond ``width`` is an error, and a line without entries has no rows (see svm_ids)."""
    lines = _numbered(spark, paths)
    parts = lines.select("id", F.split(F.trim("value"), r"\s+").alias("p"))
    out = parts.select("id", F.element_at("p", 1).cast("double").alias("label"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("e"))
    col = F.substring_index("e", ":", 1).cast("int") - 1
    if width is not None:
        col = F.when(col < width, col).otherwise(F.raise_error(F.lit(f"a column is beyond the width {width}")).cast("int"))
    out = out.filter(~F.col("e").startswith("#")).select("id", col.alias("col"), F.substring_index("e", ":", -1).cast("float").alias("val"), "label")
    return out if labels else out.drop("label")


def svm_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, label) of every line of LibSVM files, those without entries included."""
    return _numbered(spark, paths).select("id", F.substring_index(F.trim("value"), " ", 1).cast("double").alias("label"))


def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, value): the lines that are not blank, numbered by file and place."""
    from ..operators.exchange import global_rank

    lines = spark.read.text(paths).filter(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    ranked = global_rank(lines.select("file", "block", "place", "value"), [], ["file", "block", "place", "value"], "id")
    return ranked.select((F.col("id") - 1).alias("id"), "value")


def _whole(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Every file through ``decode`` (bytes -> Arrow tables)."""
    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                for table in decode(content.as_buffer().to_pybytes()):
                    yield from table.to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def _sparse_table(starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, base: int = 0) -> pa.Table:
    ids = np.repeat(np.arange(len(starts) - 1) + base, np.diff(starts))
    return pa.table({"id": pa.array(ids, pa.int64()), "col": pa.array(cols, pa.int32()), "val": pa.array(vals, pa.float32())})


def _dense_table(x: np.ndarray, base: int = 0) -> pa.Table:
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.table({"id": pa.array(np.arange(len(x)) + base, pa.int64()), "embedding": pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))})


def read_csr_binary(spark: SparkSession, path: str) -> DataFrame:
    """CSR in one binary file: int32 m, n, nnz; row starts; columns; float32 values."""
    def decode(raw: bytes):
        m, _, nnz = struct.unpack_from("<iii", raw)
        starts = np.frombuffer(raw, "<i4", m + 1, 12)
        cols = np.frombuffer(raw, "<i4", nnz, 12 + 4 * (m + 1))
        yield _sparse_table(starts, cols, np.frombuffer(raw, "<f4", nnz, 12 + 4 * (m + 1 + nnz)))

    return _whole(spark, path, decode, SPARSE)


def read_csr_text(spark: SparkSession, path: str) -> DataFrame:
    """CSR as text: `m n nnz`, then row starts, columns and values, separated by white space."""
    def decode(raw: bytes):
        fields = raw.split()
        m, nnz = int(fields[0]), int(fields[2])
        at = 3 + m + 1
        yield _sparse_table(np.array(fields[3:at], np.int64), np.array(fields[at : at + nnz], np.int32), np.array(fields[at + nnz : at + 2 * nnz], np.float32))

    return _whole(spark, path, decode, SPARSE)


def read_csr_split(spark: SparkSession, starts: str, columns: str, values: str) -> DataFrame:
    """CSR as three raw arrays (int32 starts, int32 columns, float32 values). Columns and values are
    read as records in parallel; only the row starts are read whole."""
    def records(path: str, kind: str, name: str) -> DataFrame:
        raw = spark.sparkContext.binaryRecords(path, 4).zipWithIndex()
        return raw.map(lambda r: (r[1], np.frombuffer(r[0], kind)[0].item())).toDF(f"pos long, {name} {'int' if kind == '<i4' else 'float'}")

    def decode(raw: bytes):
        s = np.frombuffer(raw, "<i4")
        yield pa.table({"id": pa.array(np.arange(len(s) - 1), pa.int64()), "start": pa.array(s[:-1], pa.int64()), "stop": pa.array(s[1:], pa.int64())})

    rows = _whole(spark, starts, decode, "id long, start long, stop long").filter("stop > start")
    at = rows.select("id", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"))
    return at.join(records(columns, "<i4", "col"), "pos").join(records(values, "<f4", "val"), "pos").select("id", "col", "val")


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """MNIST IDX images: big-endian header, then a byte a pixel."""
    def decode(raw: bytes):
        kind, dims = raw[2], raw[3]
        if raw[:2] != b"\0\0" or kind != 8 or dims < 1:
            raise ValueError("not an IDX file of unsigned bytes")
        shape = struct.unpack_from(f">{dims}i", raw, 4)
        yield _dense_table(np.frombuffer(raw, np.uint8, offset=4 + 4 * dims).reshape(shape[0], -1))

    return _whole(spark, path, decode, DENSE)


def _vecs(spark: SparkSession, path: str, width: int, kind: str) -> DataFrame:
    size = np.dtype(kind).itemsize
    records = spark.sparkContext.binaryRecords(path, 4 + size * width).zipWithIndex()

    def decode(part):
        for raw, i in part:
            if struct.unpack_from("<i", raw)[0] != width:
                raise ValueError(f"a record is not of width {width}")
            yield i, np.frombuffer(raw, kind, width, 4).astype(np.float32).tolist()

    return spark.createDataFrame(records.mapPartitions(decode), DENSE)


def read_fvecs(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Records of an int32 width and ``width`` float32; another width is an error."""
    return _vecs(spark, path, width, "<f4")


def read_bvecs(spark: SparkSession, path: str, width: int, start: int = 0, count: int | None = None) -> DataFrame:
    """Records of an int32 width and ``width`` bytes; on request only ``count`` of them from ``start``."""
    rows = _vecs(spark, path, width, "u1")
    rows = rows.filter(F.col("id") >= start)
    return rows if count is None else rows.filter(F.col("id") < start + count)


def read_npy(spark: SparkSession, paths: list[str] | str, limit: int | None = None) -> DataFrame:
    """.npy matrices, shard after shard in the order given; on request only the first ``limit`` rows."""
    out, base = None, 0
    for path in [paths] if isinstance(paths, str) else paths:
        def decode(raw: bytes, base=0):
            yield _dense_table(np.load(io.BytesIO(raw), allow_pickle=False))

        own = _whole(spark, path, decode, DENSE)
        n = own.count() if not isinstance(paths, str) else 0
        own = own.withColumn("id", F.col("id") + base)
        out, base = own if out is None else out.unionByName(own), base + n
    return out if limit is None else out.filter(F.col("id") < limit)


def read_truth_text(spark: SparkSession, path: str) -> DataFrame:
    """Neighbour table from text: `M k`, M x k ids, M x k distances."""
    def decode(raw: bytes):
        f = raw.split()
        m, k = int(f[0]), int(f[1])
        yield _truth(np.array(f[2 : 2 + m * k], np.int64), np.array(f[2 + m * k : 2 + 2 * m * k], float), m, k)

    return _whole(spark, path, decode, TRUTH)


TRUTH = "query_id long, rank long, neighbor_id long, dist double"


def _truth(ids: np.ndarray, dists: np.ndarray, m: int, k: int) -> pa.Table:
    return pa.table({"query_id": pa.array(np.repeat(np.arange(m), k)), "rank": pa.array(np.tile(np.arange(1, k + 1), m)), "neighbor_id": pa.array(ids.ravel().astype(np.int64)), "dist": pa.array(dists.ravel().astype(float))})


def read_truth_npy(spark: SparkSession, ids: str, dists: str) -> DataFrame:
    """Neighbour table from two .npy matrices of ids and distances."""
    def decode_as(name: str, kind: str):
        def decode(raw: bytes):
            x = np.load(io.BytesIO(raw), allow_pickle=False)
            m, k = x.shape
            yield pa.table({"query_id": pa.array(np.repeat(np.arange(m), k)), "rank": pa.array(np.tile(np.arange(1, k + 1), m)), name: pa.array(x.ravel().astype(kind))})

        return decode

    keys = "query_id long, rank long"
    left = _whole(spark, ids, decode_as("neighbor_id", np.int64), f"{keys}, neighbor_id long")
    return left.join(_whole(spark, dists, decode_as("dist", float), f"{keys}, dist double"), ["query_id", "rank"])


def read_hdf5(spark: SparkSession, path: str, dataset: str = "train") -> DataFrame:
    """A dataset of an HDF5 file on a mounted path, where the h5py package is installed."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("h5py is not installed; convert the file to Parquet or .npy") from e
    with h5py.File(path) as f:
        n, width = f[dataset].shape

    def rows(batches):
        import h5py

        for batch in batches:
            for at in batch.column("id").to_pylist():
                with h5py.File(path) as f:
                    yield from _dense_table(f[dataset][at : at + 4096], at).to_batches()

    return spark.range(0, n, 4096).mapInArrow(rows, DENSE)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A data set kept as Parquet: read if there, else made and written once."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)
