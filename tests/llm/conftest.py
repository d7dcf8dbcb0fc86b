import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, h bigint, spans string"


def make_rows():
    """Texts with copies, near copies, shared passages, blanks, nulls, one long text, and ids that repeat or are null."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = words(60)
    texts = [" ".join(words(rng.randint(1, 120))) for _ in range(30)]
    for i in range(12):
        base = words(80)
        texts.append(" ".join(base[:40] + passage + base[40:]))
        near = list(base)
        near[i % 80] = "Edited"
        texts += [" ".join(base), "\n".join(near), " ".join(base)]
    texts += ["", "   \t\n ", None, "a", "a b c", "A B c", "x " * 300, "|" * 500, " ".join(words(6000)), "call +1 (988) 555-2485 or bob.42@mail8.example.com 4337166598464399 42.144.35.254"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


def frame(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, None, "s", None, 1, 2, "z") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).persist()


@pytest.fixture(scope="session")
def odd_rows(rows):
    """Repeated rows, null ids and one id with two texts."""
    return [*rows, rows[0], rows[0], (None, rows[3][1]), (None, None), (None, "one two three four five six"), (5, "another text for an id that exists")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
