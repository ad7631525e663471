"""Semantic search inside tasks against all pairs scored by Spark."""

import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import search


@pytest.mark.parametrize("block,k", [(2000, 7), (3, 1), (5, 50)])
def test_semantic_topk_is_the_ranking_of_all_pairs(spark, monkeypatch, block, k):
    monkeypatch.setattr(search, "TASK_QUERIES", block)
    rng = random.Random(2)
    vector = lambda n=4: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = [(f"c{i:03d}", vector(), True) for i in range(150)] + [(f"d{i:03d}", [1.0, 1.0, 0.5, 0.0], True) for i in range(80)]
    rows += [("z0", [0.0] * 4, True), ("z1", vector(3), True), ("z2", None, True), ("z3", [1.0] * 4, False), ("z4", [1.0, None, 1.0, 1.0], True), ("z5", [], True), ("a", vector(3), True)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, is_indexed boolean").repartition(5)
    queries = spark.createDataFrame([*[(i, vector()) for i in range(9)], (20, [1.0, 1.0, 0.5, 0.0]), (21, [0.0] * 4), (22, vector(3)), (23, None)], "query_id int, vector array<double>")
    got = {(r.query_id, r.rank): (r.chunk_id, None if r.score is None else round(r.score, 9)) for r in search.semantic_topk(queries, chunks, k).collect()}
    want = search._top(search.semantic_scores(queries, chunks).withColumn("score", F.round("semantic_score", 12)), k)
    assert got == {(r.query_id, r.rank): (r.chunk_id, None if r.score is None else round(r.score, 9)) for r in want.collect()}
    assert len(got) == 13 * k


def test_nothing_to_search(spark):
    chunks = spark.createDataFrame([], "chunk_id long, embedding array<float>, is_indexed boolean")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>")
    assert search.semantic_topk(queries, chunks, 3).count() == 0 and search.semantic_topk(queries.limit(0), chunks, 3).count() == 0
    with pytest.raises(ValueError):
        search.semantic_topk(queries, chunks, 51)


def density(text, query):
    """Cover density restated: all stretches between places, the shortest that hold all words."""
    import re

    words, want = re.findall(r"[^\W_]+", text.lower()), list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not want or not set(want) <= set(words):
        return None
    ends = {}
    for e in range(len(words)):
        b = next((b for b in range(e, -1, -1) if set(want) <= set(words[b : e + 1])), None)
        if b is not None and words[e] in want:
            ends.setdefault(b, e)  # the first end of each beginning
    r = sum(1 / (e - b + 2 - len(want)) for b, e in ends.items())
    return r / (1 + r)


def test_words_of_chunks_and_of_a_kept_index(spark, monkeypatch):
    from strataframe.operators import postings

    rng = random.Random(5)
    vocabulary = ["coal", "Seam", "été", "7", "ΣΑΣ", "x_y", "日本", "of", "ore", "mine"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(120)] + [None, "", "coal " * 3000]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk string").repartition(4)
    asked = ["coal", "coal seam", "seam Coal coal", "été 7 mine", "x y", "", None, "nothing", "日本 of ore mine coal"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    want = {(q, c): pytest.approx(d, rel=1e-9) for q, query in enumerate(asked) for c, text in enumerate(texts) if (d := density(text or "", query or "")) is not None}
    monkeypatch.setattr(search, "TASK_QUERIES", 4)
    assert {(r.query_id, r.chunk_id): r.lexical_score for r in search.lexical_scores(queries, chunks).collect()} == want
    path = postings.keep_postings(chunks, 64)
    monkeypatch.setattr(postings.kept_scores, "__defaults__", ("bigint", 64))
    for some in (queries, queries.where("query_id < 2")):
        got = {(r.query_id, r.chunk_id): r.lexical_score for r in search.lexical_scores(some, chunks, path).collect()}
        ids = {r.query_id for r in some.collect()}
        assert got == {k: v for k, v in want.items() if k[0] in ids}
    plan = search.lexical_scores(queries.where("query_id = 0"), chunks, path)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
