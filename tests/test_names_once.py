"""Names are matched once, and what they are made from is read no more often than it must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import review


def test_candidates_are_read_once_for_their_names_and_once_for_their_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(kind):
        seen.add(1)
        return kind

    rows = [(i, ("MINE", "PRODUCTION", "UNKNOWN")[i % 3], f"Mine {'abc'[i % 2]}berry {i % 5}") for i in range(300)]
    c = spark.createDataFrame(rows, "id int, kind string, raw_value string").select("id", told.asNondeterministic()("kind").alias("classification"), "raw_value", F.col("raw_value").alias("normalized_value"))
    e = spark.createDataFrame([(1, "MINE", "mineaberry0"), (2, "MINE", "minebberry")], "entity_id int, entity_type string, entity_key string")
    got = review.propose_mapping(c, e).collect()
    assert len(got) == 300 and {r.mapping_status for r in got} >= {"MATCHED", "POSSIBLE_MATCH", "NEW", "UNRESOLVED"}
    assert seen.value <= 2 * 300


def test_a_candidate_told_twice_stays_two_rows(spark):
    """Matches join by name: rows of one id are not multiplied by each other."""
    c = spark.createDataFrame([(1, "MINE", "Jhariya", None), (1, "MINE", "Jhariya", None), (2, "MINE", "", None), (3, None, "Jharia", None)], "id int, classification string, raw_value string, normalized_value string")
    e = spark.createDataFrame([(7, "MINE", "jharia")], "entity_id int, entity_type string, entity_key string")
    got = sorted((r.id, r.mapping_status, r.entity_id) for r in review.propose_mapping(c, e).collect())
    assert got == [(1, "POSSIBLE_MATCH", 7), (1, "POSSIBLE_MATCH", 7), (2, "UNRESOLVED", None), (3, "NEW", None)]
