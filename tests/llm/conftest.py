"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, at int, seed long, item long, shard int, slot long, component long, f0 long, score double, h long, node long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '.', ','])}" for _ in range(n))


def rows():
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(1, 90)) for _ in range(40)]
    passage = sentence(rng, 60)
    texts = base + [base[3], base[3], base[3], base[5] + " tail", passage + "\n" + base[6], base[7] + "\n" + passage, passage, None, "", " \n\t ", "12345 !!", "é ñ ü " * 20, "x " * 9000, sentence(rng, 6000)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0, "k", "w", 1, 2, 3, 4, 5, 6, 7, 0.5, 8, 9) for i, t in enumerate(texts)]
    return [*out, out[4], (None, "null key " * 20, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
