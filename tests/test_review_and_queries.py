import datetime
import decimal
import importlib.util
import random
import re
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strataframe.functions import text as fn
from strataframe.operators import review
from strataframe.operators.canonical import fold_values
from strataframe.operators.decisions import ACTIONS, next_state, transition
from strataframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_fuzzy_match_finds_what_a_scan_finds(spark):
    names = ["talchercoalfield", "jharia", "rajmahalmine", "singrauli", "korbaeast", "northkaranpura", "mineab", "mineac", "minea"]
    like = ["talchercoalfiel", "jhariya", "rajmahalmines", "singraulli", "korbawest", "karanpura", "mineabc", "x", ""]
    e = spark.createDataFrame([(i, "MINE", n) for i, n in enumerate(names)], "entity_id int, entity_type string, entity_key string")
    c = spark.createDataFrame([(i, "MINE", n) for i, n in enumerate(like)], "id int, entity_type string, key string")
    got = {r.id: r.entity_id for r in review.fuzzy_match(c, e).collect()}
    want = {}
    for i, k in enumerate(like):
        best = max(((SequenceMatcher(None, k, n).ratio(), -j) for j, n in enumerate(names)), default=(0, 0)) if k else (0, 0)
        if best[0] >= 0.88:
            want[i] = -best[1]
    assert got == want and want


def test_names_with_a_common_word_hardly_meet(spark):
    """The rarest letter runs alone are joined, and nothing that a scan finds is lost."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["mine" + "".join(rng.choices(letters, k=rng.randint(5, 14))) for _ in range(700)]

    def changed(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 2)
        return "".join(x)

    like = [changed(rng.choice(names)) for _ in range(250)] + ["mine", "mines", "mineab", "amine"] + ["mine" + "".join(rng.choices("abc", k=6)) for _ in range(60)]
    known = spark.createDataFrame([("M", n, i) for i, n in enumerate(names)], "et string, ek string, entity_id int").groupBy("et", "ek").agg(F.min("entity_id").alias("entity_id"))
    keys = spark.createDataFrame([("M", x) for x in set(like)], "ct string, ck string")
    pairs = {(r.ck, r.ek) for r in review.candidate_pairs(keys, known).collect()}
    want = {(x, n) for x in set(like) for n in set(names) if SequenceMatcher(None, x, n).ratio() >= 0.88}
    assert want <= pairs and len(want) > 150
    assert len(pairs) < 0.01 * len(set(like)) * len(set(names))


def test_case_is_folded(spark):
    names = ["Straße", "STRASSE", "ﬁeld mine", "İstanbul", "ΣΊΣΥΦΟΣ", "Kelvin", "ŉx", "ǰa", "ſeam", "ﬀﬃﬆ", "Ա և", "plain", "", "ẞ"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", fn.case_fold(F.col("n")).alias("f"), fn.name_key(F.col("n")).alias("k")).collect():
        assert r.f == r.n.casefold(), r
        assert r.k == re.sub("[^a-z0-9]+", "", r.n.casefold())
    assert spark.range(1).select(fn.entity_key(F.lit("\U0001fbf1\U0001fbf9"))).first()[0] == "19"


def test_folded_names_are_one(spark):
    c = spark.createDataFrame([(1, "STRASSE mine", None, None, None, None), (2, "x", "ﬁ1", None, None, None), (3, "Straße mine", None, "PARENTSS", None, None)], "id int, name string, code string, parent string, lat double, lon double")
    e = spark.createDataFrame([(10, "Straße mine", None, "FI1", "parentß", None, None)], "entity_id int, canonical_name string, aliases array<string>, domain_code string, parent string, lat double, lon double")
    assert {r.id: r.identity_status for r in review.resolve_identity(c, e).collect()} == {1: "MATCHED", 2: "POSSIBLE_MATCH", 3: "MATCHED"}


def test_transitions(spark):
    from itertools import product

    from pyspark.sql import functions as F

    rows = list(product(("PENDING", "IN_REVIEW", "VERIFIED", "REJECTED", "UNRESOLVED"), ACTIONS))
    df = spark.createDataFrame(rows, "s string, a string")
    got = [tuple(r.t) for r in df.select(transition(F.col("s"), F.col("a")).alias("t")).collect()]
    assert got == [next_state(s, a) for s, a in rows]
    assert dict(zip(rows, got, strict=True))["REJECTED", "CLAIM"] == ("REJECTED", "ILLEGAL")


def test_value_conflict(spark):
    df = spark.createDataFrame([("MINE", 1, "depth", 1, "120"), ("MINE", 1, "depth", 2, "125"), ("MINE", 1, "depth", 3, "120")], "entity_type string, entity_id int, field string, seq int, value string")
    assert [r.outcome for r in fold_values(df).orderBy("seq").collect()] == ["APPENDED", "CONFLICT", "APPENDED"]


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert len(set(map(str.lower, df.columns))) == len(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duck.execute(sql)
        columns = [c[0] for c in con.description]
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in df.columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in con.fetchall()), key=repr)
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_the_training_data_operators():
    root = Path(__file__).resolve().parents[1]
    for p in root.glob("strataframe/**/*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
    assert importlib.util.find_spec("strataframe") is not None
