import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import postings, search


@pytest.mark.parametrize("held,kind", [(100_000, "long"), (30, "string")])
def test_kept_postings_are_packed_by_word(spark, monkeypatch, held, kind):
    """There was a row for each word of each chunk, and each query moved its own."""
    monkeypatch.setattr(postings, "HELD", held)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(200)]
    chunks = spark.createDataFrame([*rows, (900, None), (901, "w1 W1 w2")], "chunk_id long, chunk string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).coalesce(2)
    queries = spark.createDataFrame([("a", "w1"), ("b", "w1 w2"), ("c", "w2 w1 w3"), ("d", "w1 none"), ("e", ""), ("f", "W2 w2")], "query_id string, query string")
    path = postings.keep_postings(chunks)
    want = {(r.query_id, r.chunk_id): round(r.lexical_score, 9) for r in search.lexical_scores(queries, chunks).collect()}
    out = search.lexical_scores(queries, chunks, path)
    assert {(r.query_id, r.chunk_id): round(r.lexical_score, 9) for r in out.collect()} == want and len(want) > 100
    if held > 30:
        assert spark.read.parquet(path).count() <= 2 * 25
