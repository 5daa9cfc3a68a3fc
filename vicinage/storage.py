"""Tables and folders that the driver and every executor can reach."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of sessions that name none, by application.
_own: dict[str, str] = {}
_inside: ContextVar[str] = ContextVar("vicinage_scratch", default="")

#: How tables are written: no marker file, and on mounted paths without the checksummed local file system,
#: which starts a process of the executor's size (chmod) for every file and its checksum where Hadoop's native
#: library is missing. Parquet pages carry checksums of their own; other stores are not affected.
WRITING = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where that is unset and everything runs on one
    machine (tests, a laptop) a temporary folder, which is deleted at exit; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="vicinage-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = "file://" + _own[app]
    return root.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application writes, inside the shared folder."""
    return f"{shared_dir(spark)}/vicinage/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_inside.get() or session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that operators write inside the block are deleted at its end; write what you want to keep
    to a path from before the block, inside it."""
    token = _inside.set(fresh_path(spark, "scratch"))
    try:
        yield
    finally:
        path = _inside.get()
        _inside.reset(token)
        remove(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete everything this application has written; results that were not written elsewhere go too."""
    remove(spark, session_dir(spark))


def write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back."""
    df.write.options(**WRITING).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and a lost
    executor costs at most the tasks that were running. With ``parts``, from a known number of rows,
    into no more files than that, instead of one of a few rows from each task."""
    spark = df.sparkSession
    df = df if parts is None else df.coalesce(max(1, parts))
    path = fresh_path(spark, name)
    return write(df, path)


def local_path(uri: str) -> str | None:
    """The mounted path behind a ``file:`` URI or a bare path; None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that executors read and write."""
    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        return fs.LocalFileSystem(), path
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    return store, path
