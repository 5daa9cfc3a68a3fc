import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vicinage.llm import packing

from .conftest import awkward_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check_sequences(rows, capacity):
    """Sequences are gapless from 0 and not above the capacity; returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_awkward_rows(spark, awkward, tokenizer):
    capacity = 64
    rows = packing.pack_documents(awkward, PATH, capacity=capacity).collect()
    expected = Counter()
    for doc, text, *_ in awkward_rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[start : start + capacity], "<u4")
            expected[doc, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    total = sum(r.length for r in rows)
    assert check_sequences(rows, capacity) <= 1.02 * total / capacity + 2


def test_empty_table(empty):
    assert packing.pack_documents(empty, PATH).collect() == []


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(1)
    letters = [*"ab '´s\t\n\x0b\x1c\x1f\x85\xa0 ÀéèßİΣςσ1२½²_-!<|>,.̧́٣日本한글가", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "don't."]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    found = packing.Encoder(PATH, keep=500).encode([t.encode() for t in texts])
    for text, ids, e in zip(texts, found, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)


@pytest.mark.parametrize("kind", ["long tail", "one length", "few lengths", "two thirds"])
def test_plans_use_every_piece_and_waste_little(kind):
    rng = np.random.default_rng(2)
    if kind == "long tail":
        lengths = np.minimum(np.exp(rng.normal(6.4, 1.1, 50_000)).astype(int) + 1, 4096)
    else:
        lengths = {"one length": np.full(1000, 4096 // 3), "few lengths": rng.choice([100, 996, 2000, 3100], 5000), "two thirds": rng.choice([2700, 1396, 4096], 3000)}[kind]
    histogram = Counter(lengths.tolist())
    plan = packing.packing_plan(dict(histogram))
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 4096 and times > 0
        for n in pattern:
            used[n] += times
    assert used == histogram
    sequences = sum(t for _, t in plan)
    if kind == "long tail":
        assert sequences <= 1.001 * lengths.sum() / 4096 + 1
    fit = best_fit_count(lengths, 4096)
    assert sequences <= 1.01 * fit + 1


def best_fit_count(lengths, capacity):
    return sum(t for _, t in packing.best_fit(Counter(int(n) for n in lengths), capacity))


def test_fit_solves_an_exact_system():
    patterns = [(3, 1), (2, 2), (4,)]
    x = packing.nonnegative_fit(patterns, {3: 10, 1: 10, 2: 8, 4: 5}, 4, rounds=200)
    assert np.allclose(x, [10, 4, 5], atol=0.3)
