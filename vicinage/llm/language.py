"""Language identification by nearest centroid.

A text's vector holds the square-root counts of its hashed byte bigrams and trigrams (lower case,
anything but letters as one blank) times their inverse document frequency, at unit length. Each
language has several centroids, clustered on a bounded sample; a text takes the language of the
centroid of largest cosine and is rejected when that cosine is far below what the language's own
texts reach, short ones and long ones by themselves.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import bound_batches, release
from .sampling import smallest_hashes

#: Features, and characters of a very long text that are counted at a time.
FEATURES, PIECE = 4096, 1 << 20
#: Documents of the fitting sample in all, and centroids of a language.
SAMPLE, CENTROIDS = 4096, 4
#: A text is rejected below this share of the smallest cosine in its language's sample, one for short
#: texts, whose few n-grams may be rare ones, and one for texts of LONG letters or more.
REJECT, LONG = (0.25, 0.5), 100
_STRIDE = 256  # texts in a block
_BLANK = np.arange(256, dtype=np.uint32)
_BLANK[: ord("a")] = 32
_BLANK[ord("z") + 1 : 128] = 32


def counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed bigrams and trigrams of whole texts, a row each."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        for at in range(0, len(text), PIECE):  # very long texts by pieces
            raw = " " + text[at : at + PIECE].lower() + " "
            b = _BLANK[np.frombuffer(raw.encode("utf-8", "replace"), np.uint8)]
            b = b[(b != 32) | (np.append(1, b[:-1]) != 32)]
            pair = b[:-1] * np.uint32(256) + b[1:]
            triple = pair[:-1] * np.uint32(256) + b[2:]
            for gram, factor in ((pair, 0x9E3779B1), (triple, 0x85EBCA6B)):
                out[row] += np.bincount((gram * np.uint32(factor)) >> np.uint32(20), minlength=FEATURES)
    return out


def letters_of(text: str) -> int:
    """Letters of a text, counted up to LONG."""
    return sum(1 for _ in itertools.islice(filter(str.isalpha, text), LONG))


def weigh(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of a block of counts; an empty text stays 0."""
    x = np.sqrt(block) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


@dataclass
class Model:
    """idf, centroids (a row each), the language of each centroid, the cosines below which each rejects
    short and long texts."""

    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]
    floors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine from 0 to 1, rejected) of each text; a text with no letter is `und`."""
        size = np.array([letters_of(t) for t in texts], int)
        letters, long = size > 0, (size >= LONG).astype(int)
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = weigh(counts(texts), self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float) * letters
        names = [self.labels[k] if ok else "und" for k, ok in zip(best, letters)]
        return names, score, ~letters | (score < self.floors[best, long])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are the row nearest the mean, then the rows farthest from all seeds."""
    mean = x.mean(0)
    seeds = [int((x @ mean).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def fit(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on the rows with text and label. Document frequencies count all of them; the centroids
    are clustered on at most ``sample`` rows, an equal share a language, those of smallest hash.
    Without any such row the model has no language and predicts `und`."""
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")

    def frequency(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, _STRIDE):
                part = _texts(batch.column(0).slice(at, _STRIDE))
                seen += (counts(part) > 0).sum(0)
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate([[n], seen]))], ["feature", "n"])

    table = dict(rows.select("text").mapInArrow(frequency, "feature long, n long").groupBy("feature").agg(F.sum("n")).toPandas().itertuples(index=False))
    total = table.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([table.get(j, 0) for j in range(FEATURES)], float))).astype(np.float32) + np.float32(1)

    languages = rows.groupBy("label").count().count()
    share = max(1, sample // max(1, languages))
    chosen = smallest_hashes(rows.select("doc_id", "label"), "doc_id", "label", share).select(F.col("doc_id").alias("of"))
    picked = rows.join(F.broadcast(chosen.distinct()), F.col("doc_id").eqNullSafe(F.col("of"))).select("label", "text")

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _STRIDE):
                part = batch.slice(at, _STRIDE)
                own = _texts(part.column(1))
                x = weigh(counts(own), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([letters_of(t) >= LONG for t in own], pa.bool_())], ["label", "vector", "long"])

    by: dict[str, list[tuple[bytes, bool]]] = {}
    for name, vector, long in picked.mapInArrow(vectors, "label string, vector binary, long boolean").orderBy(F.xxhash64("vector"), "label").limit(2 * sample).orderBy("label", "vector").toPandas().itertuples(index=False):
        by.setdefault(name, []).append((vector, long))
    labels, middles, floors = [], [], []
    for name in sorted(by):
        x = np.stack([np.frombuffer(v, np.float16) for v, _ in by[name]]).astype(np.float32)
        c = cluster(x, centroids)
        reached, long = (x @ c.T).max(1), np.array([l for _, l in by[name]], bool)
        lowest = [share * float(reached[own].min(initial=reached.max())) for share, own in zip(REJECT, (~long, long))]
        labels += [name] * len(c)
        middles.append(c)
        floors += [lowest] * len(c)
    return Model(idf, np.concatenate(middles) if middles else np.zeros((0, FEATURES), np.float32), labels, np.array(floors).reshape(-1, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) and the columns of ``keep`` for every row.

    Null text or text without a letter: `und`, score 0, rejected. Whole texts count; repeated rows
    and null ids get a row each; other columns are ignored; an empty table gives no rows."""
    bound_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *[F.col(k) for k in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]

    def label(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _STRIDE):
                part = batch.slice(at, _STRIDE)
                names, score, rejected = sent.value.predict(_texts(part.column("_text")))
                kept = part.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*kept.schema.names, "lang_pred", "score", "rejected"])
        release()

    return rows.mapInArrow(label, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.filter(~held_out(F.col("doc_id"))))
    found = identify(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
