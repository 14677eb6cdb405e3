import random

import pytest

EXTRA = ["size", "kept", "_text", "_id", "_row", "piece", "class_id", "n_words", "target", "node", "label", "_key", "count"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def make(spark, rows):
    """documents of (doc_id, text, source) with columns whose names clash with what operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng, n):
    words = ["river", "stone", "the", "of", "light", "gather", "one", "evening", "slow", "tide", "a", "north", "window", "paper", "house", "quiet", "field", "amber", "song", "to"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 200)
    near = base.split(" ")
    near[100] = "changed"
    long = prose(rng, 30_000)
    rows = [(1, base, "a"), (2, base, "b"), (3, " ".join(near), "a"), (4, None, "a"), (5, "", None), (None, "no id here at all", "b"), (7, None, None), (8, long, "c")]
    rows += [(9, "twice", "c"), (9, "twice", "c"), (10, " \n\t ", "c"), (11, "x" * 40_000, "a"), (12, "naïve café — ünïcödé 漢字 \U0001f600", "b"), (None, None, None)]
    return rows + [(20 + k, prose(rng, rng.randrange(1, 120)), rng.choice(["a", "a", "a", "b", None])) for k in range(40)]


@pytest.fixture
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture
def none(spark):
    return make(spark, [])
