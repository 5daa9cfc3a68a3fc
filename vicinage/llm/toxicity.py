"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text's features x are the log counts of its words and of their beginnings, as far as these are
associated with the labels. With one weight vector w for all grades,
P(grade >= j) = sigmoid(w.x - t_j) for increasing thresholds t_j. The expected severity is the sum of
these over j.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .batches import bound_batches, release
from .sampling import smallest_hashes
from .words import U64, buffers, word_hashes

#: Labelled documents of each class that are fitted on at most, and bytes of a word's beginnings.
SAMPLE, CUTS = 3000, (4, 5, 6, 7)
#: Features at most, the number of fitted documents that one must be in, and the standard errors by
#: which its shares of the toxic and of the other documents must differ, and the least log odds between them.
VOCABULARY, LEAST, STRENGTH, ODDS = 5000, 8, 4.0, 1.5
#: ASCII other than letters separates words; bytes of other scripts are parts of words.
_ONLY_LETTERS = np.arange(256, dtype=np.uint8)
_ONLY_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the words of letters of a string column and of their beginnings."""
    data, offsets = buffers(column)
    begin = int(offsets[0])
    flat, bounds = word_hashes(_ONLY_LETTERS[data[begin : int(offsets[-1])]], offsets - begin, CUTS)
    return flat.ravel(), bounds * (1 + len(CUTS))


@dataclass
class Severity:
    """words: sorted hashes; weights of each; increasing thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, column) -> np.ndarray:
        """P(grade >= j) for j = 1.. of the texts of a column."""
        flat, bounds = features(column)
        n = len(bounds) - 1
        row, place, count = counted(flat, bounds, self.words)
        eta = np.bincount(row, np.log1p(count) * self.weights[place], n)
        return _sigmoid(eta[:, None] - self.thresholds)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, levels: int, ridge: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link likelihood with a ridge, by Adam on all rows.

    Gaps between thresholds are exponentials, so the thresholds stay in order."""
    n = len(grade)
    w = np.zeros(width)
    free = np.concatenate([[2.0], np.zeros(levels - 2)])  # first threshold, log gaps
    m, v = np.zeros(width + len(free)), np.zeros(width + len(free))
    for step in range(1, steps + 1):
        thresholds = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        eta = np.bincount(rows, values * w[columns], n)
        above = _sigmoid(eta[:, None] - thresholds)  # P(grade >= j)
        edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = edges * (1 - edges)
        own = np.arange(n)
        chance = np.maximum(edges[own, grade] - edges[own, grade + 1], 1e-9)
        by_eta = (slope[own, grade] - slope[own, grade + 1]) / chance
        by_threshold = np.zeros((n, levels - 1))
        low, high = grade > 0, grade < levels - 1
        by_threshold[own[low], grade[low] - 1] -= (slope[own, grade] / chance)[low]
        by_threshold[own[high], grade[high]] += (slope[own, grade + 1] / chance)[high]
        up = by_threshold.sum(0) / n
        gaps = np.exp(free[1:]) * np.array([up[j:].sum() for j in range(1, levels - 1)])
        gradient = np.concatenate([np.bincount(columns, values * by_eta[rows], width) / n - ridge * w, [up.sum()], gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w += move[:width]
        free += move[width:]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def counted(flat: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, count) of the vocabulary's features that texts hold."""
    if not len(vocabulary) or not len(flat):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    hit = vocabulary[at] == flat
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit]
    pair, count = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), count


def associated(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log odds) of the features associated with the label of
    (toxic, text); none without examples of both classes."""
    def local(batches):
        seen, n = [[], []], [0, 0]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, bounds = features(part.column("text"))
                for label, a, b in zip(part.column("toxic").to_pylist(), bounds[:-1], bounds[1:]):
                    seen[label].append(np.unique(flat[a:b]))
                    n[label] += 1
        both = [np.unique(np.concatenate([*s, np.zeros(0, U64)]), return_counts=True) for s in seen]
        for label, (found, count) in enumerate(both):
            hashes = pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(1, pa.int64())])
            count = np.append(count, n[label])
            yield pa.RecordBatch.from_arrays([hashes, pa.array(count * label), pa.array(count * (1 - label))], ["feature", "bad", "good"])

    sums = examples.select("toxic", "text").mapInArrow(local, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = materialize(sums, "associations")
    total = sums.filter("feature IS NULL").first()
    if total is None or not total["bad"] or not total["good"]:
        return np.zeros(0, U64), np.zeros(0)
    cells = [F.col("bad") + 0.5, F.lit(total["bad"] + 0.5) - F.col("bad"), F.col("good") + 0.5, F.lit(total["good"] + 0.5) - F.col("good")]
    odds = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    pooled = (F.col("bad") + F.col("good")) / F.lit(float(total["bad"] + total["good"]))
    error = F.sqrt(pooled * (1 - pooled) * (1 / total["bad"] + 1 / total["good"])) + 1e-12
    gap = F.abs(F.col("bad") / F.lit(total["bad"]) - F.col("good") / F.lit(total["good"]))
    able = sums.filter("feature IS NOT NULL").filter(F.col("bad") + F.col("good") >= min(LEAST, max(1, (total["bad"] + total["good"]) // 20)))
    able = able.select("feature", odds.alias("odds"), (gap / error).alias("strength"))
    strong = able.filter((F.col("strength") >= STRENGTH) & (F.abs("odds") >= ODDS))
    chosen = (able if strong.isEmpty() else strong).orderBy(F.desc("strength"), "feature").limit(VOCABULARY).toPandas()
    hashes = chosen["feature"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(hashes)
    return hashes[order], chosen["odds"].to_numpy()[order]


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Severity:
    """Fit severity grades 0, 1, 2 on labelled documents, at most ``sample`` of each class (those of
    smallest hash; the bound is the operator's one sample).

    The labels say toxic or not. Grade 0 is not toxic; a toxic document is of grade 2 if it holds
    more occurrences of features that mark toxic documents (log odds above 2) than the median toxic
    document, else of grade 1. Rows without text, label or id are no examples; without examples of
    both classes every severity is 0."""
    chosen = labels.select(F.col(doc_id).alias("of"), F.col(label).cast("int").alias("toxic")).filter("of IS NOT NULL AND toxic IN (0, 1)").groupBy("of").agg(F.max("toxic").alias("toxic"))
    chosen = smallest_hashes(chosen, "of", "toxic", sample)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    picked = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("toxic", "text")
    picked = materialize(picked.withColumn("doc", F.monotonically_increasing_id()), "examples")
    vocabulary, odds = associated(picked)
    if not len(vocabulary):
        return Severity(np.zeros(0, U64), np.zeros(0), np.array([35.0, 36.0]))

    def held(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, bounds = features(part.column("text"))
                row, place, count = counted(flat, bounds, vocabulary)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row)), pa.array(place), pa.array(count)], ["doc", "place", "count"])

    examples = picked.select("doc", "toxic").toArrow().sort_by("doc")
    toxic = examples.column("toxic").to_numpy().astype(np.int64)
    cells = picked.mapInArrow(held, "doc long, place long, count long").toArrow().sort_by([("doc", "ascending"), ("place", "ascending")])
    row = np.searchsorted(examples.column("doc").to_numpy(), cells.column("doc").to_numpy())
    column, count = cells.column("place").to_numpy(), cells.column("count").to_numpy().astype(float)
    marked = np.bincount(row, count * (odds[column] > 2), len(toxic))
    grade = np.where(toxic == 1, 1 + (marked > np.median(marked[toxic == 1])), 0).astype(np.int64)
    weights, thresholds = fit_ordinal(row, column, np.log1p(count), grade, len(vocabulary), 3)
    return Severity(vocabulary, weights, thresholds)


def score(documents: DataFrame, model: Severity, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, p_severe, is_toxic) for every row: severity is the expected grade
    from 0 to 2, and a text is toxic when grade 1 or more is the likelier.

    Null, empty and wordless texts get the grade of a text without features; whole texts count;
    repeated rows and null ids get a row each; other columns are ignored; an empty table, none."""
    bound_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def grade(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                above = sent.value.grades(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, -1]), pa.array(above[:, 0] >= 0.5)], ["doc_id", "severity", "p_toxic", "p_severe", "is_toxic"])
        release()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(grade, "doc_id long, severity double, p_toxic double, p_severe double, is_toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
