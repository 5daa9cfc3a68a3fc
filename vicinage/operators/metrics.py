"""Quality of a neighbour table against a truth table, as one-row DataFrames unless stated.

``k`` and the number of queries come from the truth, so a query with missing rows loses recall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _share(hits: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    total = truth.agg(F.count(F.lit(1)).alias("wanted"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).join(total, F.lit(True)).select((F.col("hits") / F.col("wanted")).alias(name))


def _kth(truth: DataFrame) -> DataFrame:
    return truth.groupBy("query_id").agg(F.max("dist").alias("kth"))


def recall_distance(truth: DataFrame, approx: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """recall: share of wanted neighbours found at most as far as the true k-th."""
    hits = approx.join(_kth(truth), "query_id").filter(F.col("dist") <= F.col("kth") + tolerance)
    return _share(hits, truth, "recall")


def recall_ids(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """recall: share of the true neighbours that were found."""
    return _share(truth.join(approx.select("query_id", "neighbor_id").distinct(), ["query_id", "neighbor_id"]), truth, "recall")


def recall_at_k(truth: DataFrame, approx: DataFrame, k_list: list[int] | None = None, tolerance: float = 0.0, id_only: bool = False) -> DataFrame:
    """(k, recall): recall by distance, or with ``id_only`` by neighbour, of the first k columns for
    several k; by default 2, a quarter, half and three quarters of the truth's k, and all."""
    if k_list is None:
        k = truth.agg(F.max("rank")).first()[0] or 0
        k_list = sorted({x for x in (2, k // 4, k // 2, 3 * k // 4, k) if 0 < x <= k})
    ks = F.explode(F.array(*[F.lit(int(x)) for x in k_list])).alias("k")
    true = truth.select("*", ks).filter(F.col("rank") <= F.col("k")).groupBy("k", "query_id").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("n"))
    found = approx.select("query_id", "neighbor_id", "rank", "dist", ks).filter(F.col("rank") <= F.col("k"))
    if id_only:
        right = truth.select("query_id", "neighbor_id", ks, F.col("rank").alias("place")).filter(F.col("place") <= F.col("k"))
        near = found.join(right, ["k", "query_id", "neighbor_id"])
    else:
        near = found.join(true, ["k", "query_id"]).filter(F.col("dist") <= F.col("kth") + tolerance)
    hits = near.groupBy("k").agg(F.count(F.lit(1)).alias("hits"))
    return true.groupBy("k").agg(F.sum("n").alias("wanted")).join(hits, "k", "left").select(F.col("k").cast("long").alias("k"), (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"))


def kth_error(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """rel_err: mean relative error of the distance of the last neighbour; a true distance of 0
    counts as no error if it was found and as error 1 if not."""
    both = _kth(truth).join(approx.groupBy("query_id").agg(F.max("dist").alias("got")), "query_id")
    error = F.when(F.col("kth") > 0, F.abs(F.col("got") - F.col("kth")) / F.col("kth")).otherwise((F.col("got") > 0).cast("double"))
    return both.agg(F.avg(error).alias("rel_err"))


def mean_sim(approx: DataFrame) -> DataFrame:
    return approx.agg(F.avg("dist").alias("mean_sim"))


def row_mean_sim(approx: DataFrame) -> DataFrame:
    """(query_id, mean_sim) a query."""
    return approx.groupBy("query_id").agg(F.avg("dist").alias("mean_sim"))


def check_accuracy(truth: DataFrame, approx: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """recall, rel_err and mean_sim in one row."""
    return recall_distance(truth, approx, tolerance).join(kth_error(truth, approx), F.lit(True)).join(mean_sim(approx), F.lit(True))


def frobenius_error(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """frob_err: norm of the differences of distances, rank by rank, over the norm of the true ones."""
    both = truth.select("query_id", "rank", F.col("dist").alias("t")).join(approx.select("query_id", "rank", "dist"), ["query_id", "rank"])
    gap = F.col("dist") - F.col("t")
    return both.agg((F.sqrt(F.sum(gap * gap)) / F.sqrt(F.sum(F.col("t") * F.col("t")))).alias("frob_err"))


def miss_count(truth: DataFrame, approx: DataFrame, eps: float = 1e-6) -> DataFrame:
    """misses: entries of approx whose neighbour is not a true one and is farther than the true last."""
    wrong = approx.join(truth.select("query_id", "neighbor_id"), ["query_id", "neighbor_id"], "left_anti")
    return wrong.join(_kth(truth), "query_id").filter(F.col("dist") > F.col("kth") * (1 + eps)).agg(F.count(F.lit(1)).alias("misses"))


def miss_count_tolerance(truth: DataFrame, approx: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """misses: ranks from each query's first rank on whose distance differs by more than the tolerance."""
    both = truth.select("query_id", "rank", F.col("dist").alias("t")).join(approx.select("query_id", "rank", F.col("dist").alias("a")), ["query_id", "rank"], "left")
    wrong = F.col("a").isNull() | (F.abs(F.col("a") - F.col("t")) > tolerance * F.greatest(F.lit(1.0), F.col("t")))
    first = both.groupBy("query_id").agg(F.min(F.when(wrong, F.col("rank"))).alias("first"), F.max("rank").alias("k"))
    return first.agg(F.coalesce(F.sum(F.when(F.col("first").isNotNull(), F.col("k") - F.col("first") + 1)), F.lit(0)).cast("long").alias("misses"))


def strict_match(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """match: share of queries whose neighbours are the same at every rank."""
    both = truth.select("query_id", "rank", F.col("neighbor_id").alias("t")).join(approx.select("query_id", "rank", "neighbor_id"), ["query_id", "rank"], "left")
    rows = both.groupBy("query_id").agg(F.bool_and(F.coalesce(F.col("t") == F.col("neighbor_id"), F.lit(False))).alias("same"))
    return rows.agg(F.avg(F.col("same").cast("double")).alias("match"))
