import re

from vicinage.llm import licenses

from .conftest import awkward_rows


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(licenses.WORDS, lower)


def brute(text):
    """(n_words, n_base, first, last, base labels) of one text."""
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.", "the mit  LICENSE, mit license; MIT-license", "mit x license", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. MIT license too", "general public", "apache apache license license",
    "Some code.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "available under CC BY-NC 4.0. licensed", "Licensed under CC BY-NC 4.0.", "Kelvin mit license café", "license " * 3000 + "mit license", "source binary forms permitted", "",
]


def test_base_phrases_match_brute_force(spark, awkward):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found.collect()}
    assert got == {i: brute(t) for i, t in rows}
    got = sorted(((r.doc_id, r.n_words, r.n_base) for r in licenses.scan_licenses(awkward).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])[:2]) for r in awkward_rows()), key=str)


def test_labels_of_the_index(spark):
    filler = [(100 + i, f"any prose of word{i} and the rest") for i in range(50)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + filler
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "mit-notice" in got[0].labels and "mit" in got[0].labels.split(",")
    assert "apache-2.0" in got[3].labels and "gpl-3.0" in got[4].labels
    assert got[7].labels == "mit-text" and got[8].labels == "bsd" and got[10].labels == "cc-by-nc-4.0"
    assert got[13].labels == "" and all(got[i].labels == "" and got[i].score == 0 for i, _ in filler)
    for r in got.values():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_every_notice_of_a_text_is_found(spark):
    mit = "Copyright (c) 2020 Some One. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    bsd = "Copyright (c) 2021 Some One. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: binary forms must reproduce the above notice."
    many = "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0. Released under the MIT License. Licensed under the GNU General Public License, version 3. All rights reserved."
    long = mit + " Mozilla affero lesser isc unencumbered redistribution domain terms version subject gnu." * 40
    texts = [mit + " " + bsd, many, long, *[f"any prose of word{i} and the rest" for i in range(50)]]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == {"mit-text", "bsd", "all-rights-reserved"}
    assert got[1] >= {"cc-by-nc-4.0", "apache-2.0", "mit-notice", "gpl-3.0", "all-rights-reserved"}
    assert got[2] == {"mit-text"}


def aligned(text, index, templates=licenses.TEMPLATES):
    """Labels by trying every place of every template in the text."""
    w, out = words(text), set()
    joined = " " + " ".join(w) + " "
    for k, (label, _, phrase) in enumerate(templates):
        own = [(word, at, weight) for word, t, at, weight in index if t == k]
        whole, rare = sum(x for *_, x in own), len({word for word, *_ in own})
        for shift in range(-40, len(w)):
            hits = [x for word, at, x in own if 0 <= shift + at < len(w) and w[shift + at] == word]
            if sum(hits) >= licenses.COVER * whole - 1e-9 and len(hits) >= min(2, rare) and f" {phrase} " in joined:
                out.add(label)
    return out


def test_labels_match_brute_force_for_all_pairs(spark):
    """Files of one notice, of every two, and of all; each notice is found whatever stands beside it."""
    notices = [(label, notice) for label, notice, _ in licenses.TEMPLATES]
    texts = [n for _, n in notices] + [f"{a} and some prose, {b}." for i, (_, a) in enumerate(notices) for _, b in notices[:i]] + [". ".join(n for _, n in notices)]
    made = [{label} for label, _ in notices] + [{a, b} for i, (a, _) in enumerate(notices) for b, _ in notices[:i]] + [{label for label, _ in notices}]
    seen = {}
    for t in texts:
        for word in set(words(t)):
            seen[word] = seen.get(word, 0) + 1
    index = licenses.rare_index(seen, len(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = {label for _, label in licenses.BASE}
    for r in licenses.scan_licenses(rows).collect():
        found = set(r.labels.split(",")) - set(r.base_labels.split(","))
        assert found - base == aligned(texts[r.doc_id], index) and made[r.doc_id] <= found, texts[r.doc_id]


def test_empty_table(empty):
    assert licenses.scan_licenses(empty).collect() == []


def test_no_python_in_the_plan(awkward, capsys):
    licenses.scan_licenses(awkward).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
