import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vicinage.llm import registry, surrogates

from .conftest import SCHEMA, awkward_rows
from .test_jaccard import brute as groups
from .test_mixing import brute as mixed
from .test_packing import check_sequences

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The small table and the awkward rows, with new ids."""
    own = spark.createDataFrame([(r[0] if r[0] is None else r[0] + 10**6, *r[1:5]) for r in awkward_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS).limit(120).unionByName(own).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_are_listed_and_keep_the_columns(spark, docs, sf_dir):
    assert [name for name, _ in P.STAGES] == ["language_id", "ngram_jaccard", "pii_surrogates", "source_mixing", "best_fit_packing"]
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == list(P.COLUMNS), name


def test_language_stage_drops_rejected_documents_only(spark, docs, sf_dir):
    kept = rows(P.keep_known_language(spark, docs, sf_dir))
    gone = [r for r in rows(docs) if r not in kept]
    assert set(kept) <= set(rows(docs)) and len(gone) < 15
    assert all(not re.search(r"[^\W\d_]", r[1] or "") or len(r[1]) > 10**5 or (r[0] or 0) >= 10**6 for r in gone)


def test_jaccard_stage_keeps_one_of_each_group(spark, docs, sf_dir):
    named = docs.filter("doc_id IS NOT NULL").dropDuplicates()
    kept = {r.doc_id for r in P.keep_one_of_each_group(spark, named, sf_dir).collect()}
    assert kept == {c for _, _, c in groups([(r.doc_id, r.text) for r in named.collect()])}
    twice = named.unionByName(named.limit(5))
    again = [r.doc_id for r in P.keep_one_of_each_group(spark, twice, sf_dir).collect()]
    assert sorted(again) == sorted(kept)


def test_jaccard_stage_tells_rows_of_one_id_apart(spark, docs, sf_dir):
    words = [f"{x}{y}" for x in ("al", "be", "co", "du") for y in ("ra", "to", "mi", "ne", "lu")]
    one, two, three = (" ".join(words[(i * step + 1) % 20] for i in range(40)) for step in (1, 3, 7))
    table = [(1, one), (2, one.upper()), (2, two), (2, two), (3, three), (None, one)]
    got = P.keep_one_of_each_group(spark, spark.createDataFrame([(*r, None, "a", 1) for r in table], docs.select(*P.COLUMNS).schema), sf_dir)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, one), (2, two), (3, three), (None, one)], key=str)


def test_pii_stage_changes_texts_only(spark, docs, sf_dir):
    got = rows(P.replace_personal_data(spark, docs, sf_dir))
    was = rows(docs)
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None and r[2] and r[3]) == sorted((r[0], r[2], r[3]) for r in was if r[0] is not None and r[2] and r[3])
    clean = {r[1] for r in was if r[1] and not surrogates.detect(r[1])}
    assert clean <= {r[1] for r in got} and all(r[4] == (None if r[1] is None else len(r[1])) for r in got)


def test_mixing_stage_takes_the_words(spark, docs, sf_dir):
    got = P.mix_to_weights(spark, docs, sf_dir).collect()
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall("[^\x20\x09-\x0d]+", r.text))
    want = {}
    for doc, _, _, _, taken in mixed([(r.doc_id, r.text, r.source) for r in docs.collect()], ident=True):
        if taken:
            want[doc] = want.get(doc, 0) + taken
    assert words == want


def test_empty_documents(spark, sf_dir):
    nothing = spark.createDataFrame([], SCHEMA).select(*P.COLUMNS)
    for name, stage in P.STAGES:
        assert stage(spark, nothing, sf_dir).collect() == [], name


def test_run(spark, sf_dir):
    result = P.run(spark, sf_dir).collect()
    assert result and check_sequences(result, 4096) <= sum(r.length for r in result) / 4096 + 2


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_registered_queries_cover_their_table(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    table = {"op6": "embeddings", "op7": "embeddings", "op8": "pages"}.get(name.split("_")[0], "documents")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "embeddings":
        step, k = (100, 10) if name.startswith("op6") else (20, 20)
        assert df.count() == k * source.filter(F.col("vec_id") % step == 0).count()
    else:
        key = source.columns[0]
        assert df.select(key).distinct().count() == source.count()


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_registered_queries_agree_with_their_sql(spark, sf_dir, name):
    from ..oracle import assert_same, connect

    assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], connect(sf_dir))
