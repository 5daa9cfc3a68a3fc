"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its result is
written as Parquet and read again. All stages but the last return the columns of documents; other
columns that docs may have, whatever their names, are left out. Every stage gives no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import jaccard, language, mixing, packing, surrogates
from vicinage.storage import fresh_path, materialize, scratch, write

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids up to which the rows to leave out are broadcast; they are joined beyond.
BROADCAST_IDS = 1_000_000


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; the model is fitted on the labelled rows of the
    same training fold as the query's.

    Null, empty and letterless texts have no language and go; a null lang, source or doc_id changes
    nothing; rows that repeat are decided alike, each for itself; of languages with equal cosines the
    first by name is taken; very long texts count whole. Without any labelled row all rows go."""
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model, keep=COLUMNS[1:])
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one of smallest doc_id. Rows without an id
    cannot be named and stay; of rows that repeat an id with the same text one stays, and those that
    repeat it with different texts are decided by their own sets. Null, empty and wordless texts link
    with nothing and stay; nulls in other columns change nothing; a tie cannot occur, for ids differ."""
    groups = materialize(jaccard.jaccard_components(docs), "groups")
    others = groups.filter("doc_id <> component_id")
    copies = materialize(others.select(F.col("doc_id").alias("copy")).distinct(), "copies")
    repeated = materialize(groups.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).count().filter("count > 1").select("of"), "repeated")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    kept = docs.select(*COLUMNS).join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    if repeated.isEmpty():
        return kept
    # Rows of one id are told apart by new ids, which say whose set is a copy.
    once = docs.select(*COLUMNS).join(repeated, F.col("doc_id") == F.col("of"), "left_semi").dropDuplicates(["doc_id", "text"])
    once = materialize(once.withColumn("row", F.monotonically_increasing_id()), "once")
    sets = jaccard.jaccard_components(once, doc_id="row").select(F.col("doc_id").alias("row_of"), F.col("node").alias("set"))
    gone = others.select(F.col("doc_id").alias("copy"), "node").distinct()
    once = once.join(sets, F.col("row") == F.col("row_of")).join(gone, (F.col("doc_id") == F.col("copy")) & F.col("set").eqNullSafe(F.col("node")), "left_anti")
    return kept.join(repeated, F.col("doc_id") == F.col("of"), "left_anti").unionByName(once.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by surrogates, n_chars that of the new text.

    Null texts stay null (n_chars too) and empty ones empty; a null id, lang or source changes nothing;
    equal texts get equal surrogates, so repeated rows stay equal; entities do not overlap, so there are
    no ties; very long texts are searched whole."""
    found = surrogates.pseudonymize(docs, surrogates.QUERY_KEY, keep=("lang", "source"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for every epoch that takes it whole, and the document at its
    source's cut with its words up to there.

    Null, empty and wordless texts hold no words and are not in it; a null source is a source of its
    own; rows without an id take the place of their text's hash; repeated rows count once each, and of
    rows equal in place, id and size, any may be the one that is cut."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix in sequences.

    Null and empty texts are a piece of the end id alone; rows without an id and repeated rows (the
    epochs of the mix) are packed once each; pieces equal in all may change places; only documents
    above the capacity are cut."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard", keep_one_of_each_group),
    ("pii_surrogates", replace_personal_data),
    ("source_mixing", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: a fitted model, keyed surrogates and a tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scratch(spark):
            docs = write(stage(spark, docs, sf_dir), path)
    return docs
