"""Licence scan with a positional rare-token index (DataFrame functions only).

Templates are short public licence notices. The index holds, for each template, the positions of its
words of highest inverse document frequency in the scanned corpus. Every indexed word of a file is
looked up, the postings are intersected by relative position (file position less template
position), and an alignment that covers enough of the template's rare words counts when the
template's mandatory key phrase stands in the file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place is reported, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence notices as (label, words of the notice, mandatory key phrase).
TEMPLATES = (
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)

# Words too common in any prose to be looked up.
COMMON = frozenset("a all and any are by for in into is of or that the this to under use with without 0 2 3 4".split())

#: A template's rare words that are indexed, and the share of their weight that an alignment must cover.
TEMPLATE_WORDS, COVER = 8, 0.6


def words_of(text: Column) -> Column:
    """Words of a text with A-Z as a-z; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _base_places(words: Column, base) -> Column:
    """(start, label) of every place where a base phrase's words stand consecutively."""
    def at(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in base:
            first, *rest = phrase.split()
            test = w == first
            for k, word in enumerate(rest, 1):
                test = test & (F.get(words, i + k) == word)
            found = F.when(test, F.lit(label)).otherwise(found)
        return F.when(found.isNotNull(), F.struct(i.cast("long").alias("start"), found.alias("label")))

    places = F.filter(F.transform(words, at), lambda x: x.isNotNull())
    last_words = [phrase.split()[-1] for phrase, _ in base]
    return F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in last_words])), places)


def file_postings(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row a document: its word count, base places, postings of licence words, key phrases."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()} - COMMON)
    phrases = sorted({phrase for _, _, phrase in templates})
    rows = documents.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    posting = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), _base_places(F.col("words"), base).alias("places"), posting.alias("postings"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    rows = rows.withColumn("joined", F.when(F.size("postings") > 0, joined))
    held = F.filter(F.array(*[F.when(F.contains("joined", F.lit(f" {p} ")), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())
    starts = F.transform("places", lambda x: x["start"])
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.coalesce(F.array_distinct(F.transform("places", lambda x: x["label"])), F.array().cast("array<string>")).alias("base"),
        "postings", held.alias("phrases"),
    )


def rare_index(frequency: dict[str, int], total: int, templates=TEMPLATES, size: int = TEMPLATE_WORDS) -> list[tuple[str, int, int, float]]:
    """(word, template, position, weight) of the ``size`` rarest words of every template."""
    out = []
    for k, (_, notice, _) in enumerate(templates):
        idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in notice.split() if w not in COMMON}
        rare = sorted(idf, key=lambda w: (-idf[w], w))[:size]
        out += [(w, k, i, idf[w]) for i, w in enumerate(notice.split()) if w in rare]
    return out


def scan_licenses(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """Licence labels of every document.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); score is the share
    of the best verified template's rare weight that is aligned, at least 0.5 with a base phrase,
    else 0. Null, empty and wordless texts have no words, no labels and score 0; repeated rows and
    null ids are scanned row by row; other columns are ignored; an empty table gives no rows."""
    spark = documents.sparkSession
    files = materialize(file_postings(documents, doc_id=doc_id, text=text, base=base, templates=templates), "licence-postings")
    seen = files.select(F.explode(F.array_distinct(F.transform("postings", lambda x: x["word"]))).alias("word"))
    frequency = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}  # at most a row a template word
    index = rare_index(frequency, files.count(), templates)
    table = F.broadcast(spark.createDataFrame([(*row, templates[row[1]][2]) for row in index], "word string, template int, at int, weight double, phrase string"))
    whole: dict[int, float] = {}
    for _, k, _, weight in index:
        whole[k] = whole.get(k, 0.0) + weight
    names = spark.createDataFrame([(k, label, whole[k], len({w for w, t, _, _ in index if t == k})) for k, (label, _, _) in enumerate(templates)], "of int, label string, whole double, rare int")

    found = files.filter(F.size("phrases") > 0).select("row", "phrases", F.explode("postings").alias("p"))
    hits = found.join(table, (F.col("p.word") == table["word"]) & F.array_contains("phrases", F.col("phrase"))).select("row", "template", (F.col("p.at") - table["at"]).alias("shift"), "weight")
    aligned = hits.groupBy("row", "template", "shift").agg(F.sum("weight").alias("matched"), F.count(F.lit(1)).alias("n"))
    aligned = aligned.join(F.broadcast(names), F.col("template") == F.col("of"))
    aligned = aligned.filter((F.col("matched") >= COVER * F.col("whole")) & (F.col("n") >= F.least(F.lit(2), F.col("rare"))))
    own = aligned.groupBy(F.col("row").alias("of_row")).agg(F.collect_set("label").alias("own"), F.max(F.col("matched") / F.col("whole")).alias("best"))
    rows = files.join(own, F.col("row") == F.col("of_row"), "left")
    nothing = F.array().cast("array<string>")
    labels = F.sort_array(F.array_union("base", F.coalesce("own", nothing)))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
