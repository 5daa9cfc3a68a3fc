"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key. The key space is cut into 4096 equal ranges (the key's
first three hexadecimal digits), each range of each source is
sorted by itself, and the token counts before a range come from one small prefix sum over the range
totals, so that no task ever holds a source, however hot. Each source is cut at its exact budget;
a budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Ranges of all sources up to which their offsets are broadcast (about 60 bytes each).
BROADCAST_RANGES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column, pattern: str = WORD) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Targets of sources from (source, source_size): one row a source, so its windows are small.

    Sources in code point order (null last) take ``weights`` in turn and share ``share`` times all
    sizes; none gets more than ``ceiling`` times its own size, and what is above is shared again by
    weight. Filling to one common level per weight does that at once: a source is full when the
    level exceeds ceiling * size / weight, and the sources of smallest ratio fill first."""
    everyone = Window.orderBy(F.lit(0))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), turn.alias("turn"))
    weight = reduce(lambda rest, i: F.when(F.col("turn") % len(weights) == i, F.lit(float(weights[i]))).otherwise(rest), range(len(weights)), F.lit(0.0))
    full = F.col("source_size") * F.lit(float(ceiling))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), full.alias("full"))
    ranked = ranked.withColumn("ratio", F.col("full") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / weights_left)
    # Sources up to the last full one are full; the others share what is left at the first level.
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    target = F.when(F.col("ratio") <= F.coalesce(open_level, F.col("ratio")), F.col("full")).otherwise(F.col("weight") * open_level)
    return levelled.select("source", "source_size", F.least(target, F.col("full")).alias("target"))


def mix_sources(documents: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", seed: int = 20, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0, keep: tuple[str, ...] = (), ident: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, cut) for every row of ``documents``.

    taken: the words the mix takes of the row, repeats counted; ``taken div size`` whole copies and,
    at a source's cut, the first ``cut`` words once more. The taken words of a source are its
    target rounded to whole words. Null text or no words: size 0, taken 0. Null sources form one
    source, a null doc_id has the key of ``ident`` (a string, such as a hash of the text, which spreads
    such rows over the ranges; else all have one key), and repeated rows count once each. An empty
    table gives no rows. Columns of other names are ignored unless listed in ``keep``.
    Order: md5 of seed and doc_id or ident, then doc_id and size; rows equal in all of it are alike."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), (F.lit(None).cast("string") if ident is None else ident).alias("_ident"), *[F.col(k) for k in keep])
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), "_ident", F.lit(""))))).drop("_ident")
    rows = rows.withColumn("range", F.substring("key", 1, 3))
    totals = rows.select("source", "range", "size")
    totals = totals.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).cast("long"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, ceiling)
    ranges = ranges.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("range").alias("of_range"), "offset", "source_size", "target")
    if keep:  # the offsets go to the rows if there are few, rather than the rows' columns to them
        ranges = materialize(ranges, "ranges")
        ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    start = F.col("offset") + F.col("upto") - F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) AS bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - start)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).alias("taken"), (cut % F.greatest(F.col("size"), F.lit(1))).alias("cut"), *keep)


def _ident(doc_id: str, text: str) -> Column:
    return F.when(F.col(doc_id).isNull(), F.md5(F.col(text)))


def mixed_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20) -> DataFrame:
    """The rows of the mix with all columns of ``documents``: a row for every whole copy, and for the
    row at its source's cut one more whose text ends there. A column n_chars, if any, is set to the
    length of a cut text. Null and empty texts have no words and are not in the mix; other columns,
    whatever their names, come along."""
    columns = documents.columns
    packed = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("_size"), _ident(doc_id, text).alias("_text_hash"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    mixed = mix_sources(packed, F.col("_size"), seed=seed, keep=("_row",), ident=F.col("_text_hash"))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), F.when(F.col("cut") > 0, 1).otherwise(0)))
    rows = mixed.select("_row", "cut", F.explode(copies).alias("_cut"))
    own = F.col("_row")[text]
    words = F.regexp_extract_all(own, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, 1, F.greatest(F.col("cut"), F.lit(1)).cast("int")), "")
    changed = {text: F.when(F.col("_cut"), part).otherwise(own)}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("_cut"), F.char_length(part).cast("long")).otherwise(F.col("_row")["n_chars"])
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in columns])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _ident("doc_id", "text").alias("ident")), "sizes")
    return mix_sources(sized, F.col("size"), ident=F.col("ident")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             2.0::DOUBLE * source_size AS capped FROM s),
l AS (SELECT *, capped / weight AS ratio,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(capped) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY capped / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(level) AS level, min(ratio) AS ratio FROM (SELECT * FROM l WHERE ratio > level ORDER BY ratio, source ASC NULLS LAST LIMIT 1)),
t AS (SELECT l.source, l.source_size, CASE WHEN f.ratio IS NULL OR l.ratio <= f.level THEN l.capped ELSE least(l.weight * f.level, l.capped) END AS target FROM l CROSS JOIN f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM c
"""
