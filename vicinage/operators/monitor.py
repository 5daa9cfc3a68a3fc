"""Records of a search: metrics a tree, wall time a region."""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class SearchError(ValueError):
    """A request that no data can satisfy."""


class Recorder:
    """name -> a value for each tree."""

    def __init__(self):
        self.values: dict[str, list[float]] = defaultdict(list)

    def push(self, name: str, value: float) -> None:
        self.values[name].append(float(value))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, v) for name, own in self.values.items() for i, v in enumerate(own)]
        return spark.createDataFrame(rows, "tree int, metric string, value double")

    def write(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.csv(path, header=True)

    def __str__(self) -> str:
        return "\n".join(f"{name}: {', '.join(f'{v:.4g}' for v in own)}" for name, own in self.values.items())


class Profiler:
    """region -> seconds in all its visits; regions nest."""

    def __init__(self):
        self.seconds: dict[str, float] = defaultdict(float)

    @contextmanager
    def region(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - began

    def reset(self) -> None:
        self.seconds.clear()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.seconds.items()), "region string, seconds double")

    def write(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.csv(path, header=True)

    def __str__(self) -> str:
        return "\n".join(f"{name}: {s:.3f} s" for name, s in self.seconds.items())
