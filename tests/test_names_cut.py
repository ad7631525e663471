"""Names of one family meet by what is left of them when letters are cut: all that a scan finds, without a row for each pair."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from strataframe.operators import review


def tables(spark, keys, names):
    """Keys of candidates and entities ``(type, name)``, entities numbered from the last."""
    k = spark.createDataFrame(sorted(set(keys)), "ct string, ck string")
    e = spark.createDataFrame([(len(names) - i, t, n) for i, (t, n) in enumerate(names)], "entity_id int, entity_type string, entity_key string")
    return k, e


def scan(keys, names):
    """The best of all pairs, ties to the smallest id."""
    out = {}
    for t, x in set(keys):
        best = max(((SequenceMatcher(None, x, n).ratio(), i - len(names)) for i, (s, n) in enumerate(names) if s == t and x and n), default=(0, 0))
        if best[0] >= review.FUZZY:
            out[t, x] = (-best[1], best[0])
    return out


def found(spark, keys, names):
    return {(r.ct, r.ck): (r.entity_id, r.score) for r in review.best_matches(*tables(spark, keys, names)).collect()}


def changed(rng, x, letters):
    x = list(x)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(x) + 1)
        x[i : i + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 2)
    return "".join(x)


@pytest.mark.parametrize(("stem", "letters", "seed"), [("minealpha", "0123456789", 1), ("", "ab", 2), ("", "abc1", 3), ("governmentopencastmine", "0123456789", 4)])
def test_families_of_names_match_as_in_a_scan(spark, stem, letters, seed):
    """Numbers behind one stem, texts of few letters (where blocks miss letters in common), and stems whose pairs are not short."""
    rng = random.Random(seed)
    names = [(rng.choice("MP"), stem + "".join(rng.choices(letters, k=rng.randint(1, 6) if stem else rng.randint(1, 14)))) for _ in range(150)]
    keys = [(rng.choice("MMMP"), changed(rng, n, letters)) for _, n in names for _ in range(2)] + [("N", names[0][1])]
    keys = [(t, k) for t, k in keys if k]
    want = scan(keys, names)
    assert found(spark, keys, names) == want and len(want) > 50


def test_short_and_long_lengths_of_one_key(spark, monkeypatch):
    """A key may have partners of short lengths and of others; the best of both counts."""
    monkeypatch.setattr(review, "WAYS", 20)
    rng = random.Random(5)
    names = [("M", "".join(rng.choices("abc", k=rng.randint(8, 13)))) for _ in range(200)]
    keys = [("M", changed(rng, n, "abc")) for _, n in names]
    want = scan(keys, names)
    assert found(spark, keys, names) == want and len(want) > 50


def test_a_family_is_not_paired_with_itself(spark, monkeypatch):
    """Ratios taken grow with the names and not with their pairs: 400 known numbers and 800 others behind one stem."""
    names = [("M", f"minealpha{i:04d}") for i in range(400)]
    keys = [("M", f"minealpha{i:04d}") for i in range(400, 1200)]
    compared, ratio = spark.sparkContext.accumulator(0), review.similarity

    def counted(a, b, least=0.0):
        compared.add(len(a))
        return ratio(a, b, least)

    monkeypatch.setattr(review, "similarity", counted)
    got = found(spark, keys, names)
    assert got == scan(keys, names) and len(got) > 400
    assert 0 < compared.value <= 4 * len(keys)


def test_a_key_is_cut_to_the_lengths_of_its_partners_alone(spark):
    k, e = tables(spark, [("M", "minealpha0500"), ("M", "zz1")], [("M", "minealpha0001"), ("M", "minealpha0002")])
    known = e.select(F.col("entity_type").alias("et"), F.col("entity_key").alias("ek"), "entity_id")
    lengths = review._lengths(k, known, review.FUZZY)
    assert [(r.a, r.b, r.m, r.short) for r in lengths.collect()] == [(13, 13, 12, True)]
    left = {r.left for r in review._cut(k, "ct", "ck", lengths.withColumn("k", F.col("m")), "a").collect()}
    assert left == {"minealpha0500"[:i] + "minealpha0500"[i + 1 :] for i in range(13)}
