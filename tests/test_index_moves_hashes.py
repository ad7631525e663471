from strataframe.operators import chunk


def test_texts_are_not_moved_where_they_are_not_asked_for(spark):
    old = spark.createDataFrame([(1, "a", None, None, None, False), (2, None, None, None, None, False), (3, "c", None, None, None, False)], "chunk_id long, chunk string, embedding array<float>, embedding_model string, embedding_dimension int, is_indexed boolean")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (4, "e")], "chunk_id long, chunk string")
    out = chunk.merge_chunks(old, new, "m", 2)
    assert {r.chunk_id: (r.chunk, r.change) for r in out.collect()} == {1: ("a", "KEPT"), 2: (None, "KEPT"), 3: ("d", "CHANGED"), 4: ("e", "ADDED")}
    vectors = spark.createDataFrame([(1, "x", [1.0, 2.0])], "id long, text_hash string, vector array<float>")
    for rows in (out.select("change"), chunk.attach_vectors(old, vectors, "m", 2).select("chunk_id", "is_indexed")):
        above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
        assert "sha2(" in below.split("\n", 1)[1] and "sha2(" not in above  # texts met in the join themselves
