import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.llm import language, toxicity

from .conftest import SCHEMA, awkward_rows

TONGUES = {"en": "the and ing tion her of that with", "fr": "les des ment que eau oi elle était", "de": "und der sich heit ung für nicht schön"}


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        parts = TONGUES[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def test_languages_of_held_out_texts(spark):
    docs = corpus(spark)
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    assert sorted(set(model.labels)) == sorted(TONGUES) and len(model.labels) == 3 * language.CENTROIDS
    found = language.identify(docs, model, keep=("lang",)).filter(language.held_out(F.col("doc_id"))).collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert not any(r.rejected for r in found) and all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(spark, awkward, empty):
    model = language.fit(corpus(spark))
    found = language.identify(awkward, model).collect()
    assert len(found) == len(awkward_rows())
    by = {r.doc_id: r for r in found}
    for doc in (5000, 5001, 5002, 5005):
        assert (by[doc].lang_pred, by[doc].score, by[doc].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in TONGUES for d, r in by.items() if d not in (5000, 5001, 5002, 5005))
    assert language.identify(empty, model).collect() == []


def test_signs_that_are_no_letters(spark):
    model = language.fit(corpus(spark))
    texts = ["½ ² ³", "Ⅷ", "① 12 _", "٣ २", "ª", "中", None, ""]
    found = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r.lang_pred == "und" for r in sorted(found, key=lambda r: r.doc_id)] == [True, True, True, True, False, False, True, True]


def test_the_fit_does_not_change_with_repeated_ids(spark):
    docs = corpus(spark)
    many = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.col("doc_id") % 7))
    one, two = (language.fit(many.repartition(n), sample=20) for n in (2, 5))
    assert one.labels == two.labels and np.array_equal(one.centroids, two.centroids)


def test_prose_of_an_unlearned_language_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    rng = random.Random(0)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    assert model.predict([finnish, noise])[2].tolist() == [True, True]
    kept = language.identify(docs, model, keep=("lang",)).filter("lang IS NOT NULL")
    assert kept.filter("rejected").count() == 0 and kept.filter("lang <> lang_pred").count() <= 0.05 * kept.count()


def test_counts_by_pieces_are_those_of_the_whole(monkeypatch):
    text = "The first, second & THIRD parts été " * 5_000
    whole = language.counts([text, ""])
    monkeypatch.setattr(language, "PIECE", 10_000)
    parts = language.counts([text, ""])
    assert whole[1].sum() == 0 and np.abs(whole - parts).sum() <= 10 * (len(text) // 10_000 + 1)


def test_nothing_to_learn_from(spark, empty, awkward):
    model = language.fit(empty)
    assert {(r.lang_pred, r.score, r.rejected) for r in language.identify(awkward, model).collect()} == {("und", 0.0, True)}


def toxic_corpus(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 9) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vile,", "VILE", "scum!", "rotten", "(foul)"])
        rows.append((i, " ".join(words), None, None, None, None, None, None, None))
        if i < 300:
            labels.append((i, None if i % 50 == 49 else int(toxic), 1))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 0), (3, 0, 0)], "doc_id long, toxic int, quality int")


def test_severity_of_unlabelled_texts(spark, awkward, empty):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([found[i].is_toxic == (i % 5 == 0) for i in range(300, 400)]) >= 0.97
    hits = {r.doc_id: sum(w in r.text.lower() for w in ("vile", "scum", "rotten", "foul")) for r in docs.collect()}
    many = [found[i].severity for i, n in hits.items() if n >= 4]
    few = [found[i].severity for i, n in hits.items() if 1 <= n <= 2]
    assert np.mean(many) > np.mean(few) > 0.3
    awkward_found = toxicity.score(awkward, model).collect()
    plain = {r.severity for r in awkward_found if r.doc_id in (5000, 5001, 5002)}  # null, empty, wordless
    assert plain == {r.severity for r in toxicity.score(spark.createDataFrame([(1, "zzz")], "doc_id long, text string"), model).collect()} and len(plain) == 1
    assert len(awkward_found) == len(awkward_rows()) and not any(r.is_toxic for r in awkward_found)
    assert toxicity.score(empty, model).collect() == []


def test_no_examples_of_one_class(spark, empty):
    docs, labels = toxic_corpus(spark, 50)
    model = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r.severity < 1e-9 and not r.is_toxic for r in toxicity.score(docs, model).collect())


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(3000)
    grade = np.digitize(2 * x + rng.logistic(size=3000), [-1.0, 1.5])
    w, thresholds = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, int), x, grade, 1, 3, ridge=0.0)
    assert w[0] == pytest.approx(2, abs=0.25) and thresholds == pytest.approx([-1.0, 1.5], abs=0.25)
