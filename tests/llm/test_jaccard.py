import random
import re

import numpy as np
import pytest

from vicinage.llm import jaccard
from vicinage.llm.components import components
from vicinage.llm.words import hash_word, word_hashes

from .conftest import awkward_rows


def shingles(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows):
    """(doc_id, n, component) of every row by testing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return sorted(((doc, len(sets[i]), smallest.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_awkward_rows_match_brute_force(spark, awkward):
    assert got(jaccard.jaccard_components(awkward)) == brute([r[:2] for r in awkward_rows()])


def test_empty_table(empty):
    assert jaccard.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_at_the_threshold(spark, seed):
    """Families whose members differ by growing edits, around the similarity of 0.8 and of sizes around
    the bands' ends: links form chains."""
    rng = random.Random(seed)
    rows = []
    for family in range(30):
        size = rng.choice([4, 5, 8, 9, 10, 12, 15, 16, 17, 20, 31, 33, 40, 64, 70, 130])
        words = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
        for step in range(6):
            rows.append((family * 10 + step, " ".join(words)))
            edit = rng.random()
            at = rng.randrange(len(words))
            words = list(words)
            if edit < 0.5:
                words.append(f"w{rng.randrange(10**6)}")
            elif edit < 0.8:
                words[at if rng.random() < 0.2 else -1] = f"w{rng.randrange(10**6)}"
            elif len(words) > 6:
                words.pop()
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert got(found) == brute(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Hot signatures travel unpacked, leaders are drawn again, and the result stays exact."""
    monkeypatch.setattr(jaccard, "PACKED", 4)
    monkeypatch.setattr(jaccard, "COMPARED", 0)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_signatures_of_linked_sets_meet():
    """Under any order of the signatures the first of linked sets have one in common."""
    rng = np.random.default_rng(0)

    def first(x, order):
        found = []
        for _, values in jaccard.signatures(x):
            places = (values * np.uint64(2 * order + 1)) >> np.uint64(7)
            found.append(values[np.argsort(places, kind="stable")][: jaccard.needed(len(x))])
        return np.concatenate([np.zeros(0, np.uint64), *found])

    for a in [4, 5, 7, 8, 13, 16, 30, 31, 32, 63, 64, 100, 127, 128, 300, 1000]:
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**64, a, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, a // 5) + 1))
            add = int(rng.integers(0, max(1, a // 5) + 1))
            y = np.unique(np.concatenate([x[rng.permutation(a)[drop:]], rng.integers(0, 2**64, add, dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                for order in (0, 12345, 99991):
                    if len(first(x, 0)) > jaccard.needed(a) or len(first(y, 0)) > jaccard.needed(len(y)) or a.bit_length() == len(y).bit_length():
                        assert len(np.intersect1d(first(x, order), first(y, order))) or (len(x) == len(y) == common)


def test_links_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    one, three = list(words), list(words)
    one[0:4], three[56:60] = ["a", "b", "c", "d"], ["e", "f", "g", "h"]
    rows = [(1, " ".join(one)), (None, " ".join(words)), (3, " ".join(three)), (None, "only " + " ".join(words[:20])), (None, "Only " + " ".join(words[:20]) + " more"), (None, None)]
    found = got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows) and {c for d, _, c in found if d in (1, 3)} == {1}


def test_a_passage_in_many_texts_makes_no_candidates(spark):
    """Texts that share a passage but not most of their words meet under none of their signatures."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([*passage, *[f"x{rng.randrange(10**9)}" for _ in range(60)]])) for i in range(60)]
    rows += [(100 + i, text.replace("p7 ", "q7 ")) for i, text in rows[:5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(frame)) == brute(rows)
    from pyspark.sql import functions as F

    found = jaccard._find(frame.withColumn("key", F.xxhash64("text")), 5)
    nodes = found.filter("kind = 0 AND n > 0").groupBy("node", "n", "even", "odd").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("row"))
    members = jaccard._members(found, nodes)
    met = members.groupBy("sig").count().filter("count > 1").agg(F.max("count")).first()[0]
    assert met == 2


def test_sketch_distance_is_at_most_the_difference():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for k in (0, 1, 10, 100):
        y = np.concatenate([x[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])
        bits = np.bitwise_count(jaccard.sketch(x).view(np.uint64) ^ jaccard.sketch(y).view(np.uint64)).sum()
        assert bits <= 2 * k


def test_word_hashes_across_pieces(monkeypatch):
    from vicinage.llm import words

    text = "  Alpha beta\tGAMMA delta " * 40 + "x" * 5000 + " end"
    whole = [hash_word(w) for w in text.split()]
    monkeypatch.setattr(words, "_PIECE", 37)
    raw = np.frombuffer((text + text).encode(), np.uint8)
    flat, bounds = word_hashes(raw, np.array([0, len(text), 2 * len(text)]))
    n = len(whole)
    assert flat[:n].tolist() == whole and bounds.tolist()[0] == 0 and len(flat) == bounds[-1]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)]
    labels = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(labels[i] == 0 for i in range(201)) and labels[500] == 400
