import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vicinage.llm import mixing

from .conftest import awkward_rows


def brute(rows, weights=(3.0, 1.0, 2.0), seed=20, ident=False):
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source) rows, step by step; with
    ``ident`` a row without an id has the key of its text's hash."""
    name = {i: hashlib.md5(t.encode()).hexdigest() if ident and d is None and t is not None else "" if d is None else str(d) for i, (d, t, _) in enumerate(rows)}
    rows = [(d, len(re.findall("[^\x20\x09-\x0d]+", t or "")), s) for d, t, s in rows]
    rows = [(*r, name[i]) for i, r in enumerate(rows)]
    sizes = defaultdict(int)
    for _, n, s, _ in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, todo, left = {}, set(order), 1.5 * sum(sizes.values())
    while todo:
        total = sum(weight[s] for s in todo)
        over = [s for s in todo if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in todo}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            todo.remove(s)
        left -= sum(2 * sizes[s] for s in over)
    out = []
    for s in order:
        budget = round(target[s])
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"{seed}:{r[3]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for d, n, *_ in own:
            cut = max(0, min(n, rest))
            rest -= cut
            out.append((d, n, sizes[s], target[s], epochs * n + cut))
    return sorted(out, key=str)


def same(found, expected):
    found = sorted((tuple(r) for r in found), key=str)
    assert [(r[0], r[1], r[2], r[4]) for r in found] == [(r[0], r[1], r[2], r[4]) for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected])


def test_awkward_rows_match_brute_force(awkward):
    found = mixing.mix_sources(awkward, mixing.word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
    expected = brute([(r[0], r[1], r[3]) for r in awkward_rows()])
    same(found.collect(), expected)
    assert all(taken <= 2 * size for _, size, _, _, taken in expected)


def test_many_small_sources_fill_up_and_the_rest_is_shared_again(spark):
    rows = [(i, "w " * (1 + i % 3), f"s{i % 9}") for i in range(60)] + [(1000 + i, "w " * 50, "hot") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(frame, mixing.word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
    same(found.collect(), brute(rows))


def test_empty_table(empty):
    assert mixing.mix_sources(empty, mixing.word_count(F.col("text"))).collect() == []
    assert mixing.mixed_documents(empty).collect() == []


def test_mixed_documents_hold_the_taken_words(awkward):
    taken = mixing.mix_sources(awkward, mixing.word_count(F.col("text"))).groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0")
    held = mixing.mixed_documents(awkward).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert sorted(taken.collect(), key=str) == sorted(held.collect(), key=str)
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_reruns_agree(awkward):
    size = mixing.word_count(F.col("text"))
    first = mixing.mix_sources(awkward, size).select("doc_id", "taken").collect()
    again = mixing.mix_sources(awkward.repartition(3), size).select("doc_id", "taken").collect()
    assert sorted(first, key=str) == sorted(again, key=str)


def test_rows_without_an_id_are_spread(spark):
    """They are as many keys as texts, so no range of a source holds them all."""
    rows = [(None, f"text {i} " + "w " * (i % 5), "a") for i in range(400)] + [(i, "w w w", "b") for i in range(50)] + [(None, None, "a"), (None, "text 1", "a"), (None, "text 1", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(frame, mixing.word_count(F.col("text")), ident=F.md5("text")).select("doc_id", "size", "source_size", "target", "taken")
    same(found.collect(), brute(rows, ident=True))
    again = mixing.mix_sources(frame.repartition(7), mixing.word_count(F.col("text")), ident=F.md5("text")).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
