"""Quantiles selected by ranges against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import production, quantiles

P = [0.0, 0.25, 0.5, 0.9, 1.0]


def values():
    rng = random.Random(4)
    groups = {
        "even": [float(i) for i in range(400)], "odd": [float(i) for i in range(401)], "one": [7.0], "two": [1.0, 2.0], "ties": [5.0] * 300 + [6.0] * 300, "equal": [3.5] * 500,
        "wild": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(700)], "negative": [-rng.random() for _ in range(333)], "none": [None] * 9, "gaps": [1e-9] * 299 + [1e9] * 301, None: [rng.gauss(0, 1) for _ in range(600)],
    }
    return groups


@pytest.mark.parametrize("limit", [40, 350, 1 << 20])
def test_quantiles_of_groups(spark, limit, monkeypatch):
    monkeypatch.setattr(quantiles, "RANGES", 16)
    groups = values()
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.k0: r.q for r in quantiles.quantiles(quantiles.kept_values(df, "v", ("g",)), 1, P, limit).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        if not vs:
            assert got[g] is None
            continue
        for p, x in zip(P, got[g], strict=True):
            at = (len(vs) - 1) * p
            a, b = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            assert x == pytest.approx(a if a == b else (np.floor(at) + 1 - at) * a + (at - np.floor(at)) * b, rel=1e-12), (g, p)


def test_statistics_and_anomalies_do_not_depend_on_the_limit(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i % 3, rng.lognormvariate(0, 3)) for i in range(900)], "g int, v double")
    same = lambda f: [sorted(map(tuple, f(limit).collect())) for limit in (10, 1 << 20)]
    for keys in ((), ("g",)):
        a, b = same(lambda limit, keys=keys: production.statistics(df, "v", keys, 90, limit=limit).select(*keys, "n", "min", "max", F.round("median", 9), F.round("percentile", 9)))
        assert a == b and a
        a, b = same(lambda limit, keys=keys: production.anomalies(df, "v", "iqr", 1.5, keys, limit=limit).select("v", F.round("score", 9), "anomaly"))
        assert a == b and {x[-1] for x in a} == {"NORMAL", "ANOMALY"}


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "g int, v double")
    r = production.statistics(none, "v").first()
    assert r.n == 0 and r["sum"] is None and r.median is None and r.percentile is None
    assert production.statistics(none, "v", ("g",)).count() == 0 and production.anomalies(none, "v", "iqr").count() == 0


def test_a_large_group_is_not_held_by_a_task(spark):
    """Of two million values only some thousands are left when they are counted one by one."""
    df = spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
    rows = quantiles.kept_values(df, "v", ())
    got = quantiles.quantiles(rows, 0, [0.25, 0.75], 20_000).first().q
    assert got == pytest.approx(rows.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))).first()[0], rel=1e-12)
