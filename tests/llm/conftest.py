import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, score string, `rank` string"


def awkward_rows(seed=3, n=60):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fa", "gi", "ho") for b in ("ra", "to", "mi", "ne", "lu")]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i, text, "en" if i % 2 else None, ("a", "b", "c", None)[i % 4], len(text), "x", "y", "z", "r"))
        parts = text.split()
        if i % 5 == 0 and len(parts) > 40:  # a near copy
            parts[3] = "changed"
            rows.append((1000 + i, " ".join(parts), None, "a", None, None, None, None, None))
        if i % 7 == 0:  # an exact copy, upper case and with other blanks
            rows.append((2000 + i, text.upper().replace(" ", "\n\t"), "de", "b", 1, None, None, None, None))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows += [
        (5000, None, None, None, None, None, None, None, None),
        (5001, "", "en", "a", 0, None, None, None, None),
        (5002, " \n\t ", "en", "a", 4, None, None, None, None),
        (5003, " é ß", "fr", "d", 4, None, None, None, None),
        (5004, "one", "en", "d", 3, None, None, None, None),
        (5005, "12 34 !!", None, "d", 8, None, None, None, None),
        (None, "a row without any id at all, of nine words", None, None, None, None, None, None, None),
        (5006, long, "en", "e", len(long), None, None, None, None),
        (5007, "x" * 300_000, "en", "e", 300_000, None, None, None, None),
        rows[1], rows[1],
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
