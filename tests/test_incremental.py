"""What is kept between batches: the bucketed index, accepted uploads, decisions that span tasks and batches."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataframe.operators import decisions
from strataframe.streaming import index, jobs, uploads

CHUNKS = "chunk_id long, chunk string"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


@pytest.fixture
def kept(spark, tmp_path):
    """An index of 20,000 chunks in 128 buckets, every second with a vector."""
    path = str(tmp_path / "index")
    rows = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(k)), 256) for k in map(str, range(4))]).alias("chunk"))
    assert index.merge(spark, path, rows, "m", 2, "first", 128) == 1
    vectors = rows.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("id"), F.sha2("chunk", 256).alias("text_hash"), F.array(F.lit(0.5).cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    assert index.attach(spark, path, vectors, "m", 2, "vectors", 128) == 2
    return path, rows


def test_a_small_batch_writes_little(spark, kept):
    path, rows = kept
    some = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(128)) < 6).limit(200).withColumn("chunk", F.concat(F.lit("new "), "chunk"))
    before = size(f"{path}/data/written=2")
    assert index.merge(spark, path, some, "m", 2, "second", 128) == 3
    assert 0 < size(f"{path}/data/written=3") < 0.1 * before
    changes = {r.change: r["count"] for r in index.read_index(spark, path).groupBy("change").count().collect()}
    assert changes == {"CHANGED": 200, "KEPT": 19_800}
    old = index.read_index(spark, path, 2)
    assert old.count() == 20_000 and not old.where("chunk LIKE 'new %'").count()


def test_a_repeated_batch_changes_nothing(spark, kept):
    path, rows = kept
    assert index.merge(spark, path, rows.where("chunk_id < 50"), "m", 2, "again", 128) is None  # the same texts
    changed = rows.where("chunk_id < 50").withColumn("chunk", F.lit("x"))
    assert index.merge(spark, path, changed, "m", 2, "b1", 128) == 3
    assert index.merge(spark, path, changed.withColumn("chunk", F.lit("y")), "m", 2, "b1", 128) is None  # the label is known
    assert index.versions(spark, path) == [1, 2, 3]


def test_old_versions_are_dropped(spark, kept):
    path, rows = kept
    index.merge(spark, path, rows.where("chunk_id = 7").withColumn("chunk", F.lit("x")), "m", 2, "b1", 128)
    want = sorted(map(tuple, index.read_index(spark, path).select("chunk_id", "chunk", "is_indexed").collect()))
    assert index.drop_versions(spark, path) >= 128
    assert index.versions(spark, path) == [3]
    assert sorted(map(tuple, index.read_index(spark, path).select("chunk_id", "chunk", "is_indexed").collect())) == want


def test_the_flag_follows_model_and_vector(spark, kept):
    path, rows = kept
    some = rows.where("chunk_id < 4")
    assert index.merge(spark, path, some, "other", 2, "b1", 128) == 3  # vectors are of another model now
    got = {r.chunk_id: (r.is_indexed, r.change) for r in index.read_index(spark, path).where("chunk_id < 6").collect()}
    assert got == {0: (False, "FLAGGED"), 1: (False, "KEPT"), 2: (False, "FLAGGED"), 3: (False, "KEPT"), 4: (True, "KEPT"), 5: (False, "KEPT")}
    assert index.merge(spark, path, some, "m", 2, "b2", 128) == 4  # stored vectors are found valid again
    assert {r.chunk_id for r in index.read_index(spark, path).where("is_indexed AND chunk_id < 6").collect()} == {0, 2, 4}


def test_an_empty_index_and_null_texts(spark, tmp_path):
    path = str(tmp_path / "i")
    none = spark.createDataFrame([], CHUNKS)
    assert index.merge(spark, path, none, "m", 2, "b0") is None and index.read_index(spark, path).count() == 0
    assert index.merge(spark, path, spark.createDataFrame([(1, None), (2, "a"), (2, "b"), (2, "b")], CHUNKS), "m", 2, "b1") == 1
    assert index.merge(spark, path, spark.createDataFrame([(1, None), (2, "b")], CHUNKS), "m", 2, "b2") is None
    assert sorted((r.chunk_id, r.chunk) for r in index.read_index(spark, path).collect()) == [(1, None), (2, "b")]


def test_uploads_are_accepted_once_over_all_time(spark, tmp_path):
    path = str(tmp_path)
    files = "id long, content string, ts timestamp_ntz"
    batches = [
        [(1, "a", "2024-01-01"), (2, "b", "2024-01-01"), (3, "a", "2024-01-02")],
        [(4, "b", "2024-05-01"), (5, "c", "2024-05-02"), (6, "c", "2024-05-01"), (7, None, "2024-05-01")],
        [(8, "a", "2025-01-01"), (9, None, "2025-01-01"), (10, "d", None)],
    ]
    frame = lambda rows: spark.createDataFrame(rows, "id long, content string, t string").select("id", "content", F.col("t").cast("timestamp_ntz").alias("ts"))
    for n, rows in enumerate(batches):
        uploads.accept(spark, path, frame(rows), n)
    want = {1: 1, 2: 2, 3: 1, 4: 2, 5: 6, 6: 6, 7: 7, 8: 1, 9: 7, 10: 10}
    read = lambda: {r.id: (r.surviving_id, r.duplicate) for r in uploads.uploads(spark, path).collect()}
    assert read() == {k: (v, k != v) for k, v in want.items()}
    uploads.accept(spark, path, frame(batches[1]), 1)  # repeated after a failure
    assert read() == {k: (v, k != v) for k, v in want.items()}
    assert files and spark.read.parquet(f"{path}/known").count() == 5


def folded(start, log):
    out, state = [], start
    for seq, action, actor in log:
        before = state
        state, outcome = (None, "NOT_FOUND") if state is None else decisions.next_state(state, action)
        out.append((seq, action, actor, before, state, outcome))
    return out


def test_decisions_of_all_kinds(spark):
    rng = random.Random(5)
    kinds = [*decisions.ACTIONS, "UNHEARD_OF", None]
    starts = {1: "PENDING", 2: "VERIFIED", 3: "ODD", 4: None, 5: "UNRESOLVED", 6: "IN_REVIEW"}
    logs = {k: [(s, rng.choice(kinds), rng.randrange(9)) for s in range(rng.choice([1, 3, 400]))] for k in (1, 2, 3, 4, 5, 6, 7, None)}
    rows = [(k, *x) for k, log in logs.items() for x in log]
    rng.shuffle(rows)
    out = decisions.fold_decisions(spark.createDataFrame(list(starts.items()), "id long, verification_status string"), spark.createDataFrame(rows, "id long, seq long, action string, actor long").repartition(5))
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    for k, log in logs.items():
        key = lambda x: x[0]
        assert sorted(got[k], key=key) == folded(starts.get(k), log), k
    assert not decisions.fold_decisions(spark.createDataFrame([], "id long, verification_status string"), spark.createDataFrame([], "id long, seq long, action string, actor long")).count()


def test_a_million_decisions_on_one_candidate(spark):
    n = 1_000_000
    kind = F.element_at(F.array(*map(F.lit, decisions.ACTIONS)), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    log = spark.range(n).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("seq"), F.when(F.col("id") < 999_000, F.lit("REJECT")).otherwise(kind).alias("action"), F.lit(0).cast("long").alias("actor"))
    out = decisions.fold_decisions(spark.createDataFrame([(1, "PENDING")], "id long, verification_status string"), log, ranges=8)
    assert out.count() == n and len(log.repartitionByRange(8, "id", "seq").groupBy(F.spark_partition_id()).count().collect()) == 8
    last = out.where("seq >= 998999").orderBy("seq").collect()
    state = "REJECTED"
    assert last[0].state == state and last[0].outcome == "NO_OP"
    for r in last[1:]:
        before, (state, outcome) = state, decisions.next_state(state, r.action)
        assert (r.previous_state, r.state, r.outcome) == (before, state, outcome)


def test_idle_candidates_are_forgotten(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    schema = "id long, seq long, action string, ts timestamp"
    days = [[(1, 2, "APPROVE", 3), (2, 1, "CLAIM", 0)], [(1, 1, "CLAIM", 2)], [(3, 1, "CLAIM", 40)], [(2, 2, "APPROVE", 41), (1, 3, "CLAIM", 41)], [(9, 1, "CLAIM", 99)]]
    for rows in days:
        df = spark.createDataFrame([(i, s, a, d) for i, s, a, d in rows], "id long, seq long, action string, d int")
        df.select("id", "seq", "action", F.timestamp_add("DAY", "d", F.lit("2024-01-01").cast("timestamp")).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, idle, want in (("keep", None, "VERIFIED"), ("idle", 10 * 86_400_000, "IN_REVIEW")):
        out = jobs.stream_decisions(session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late="5 days", idle_ms=idle)
        out.writeStream.option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/{name}").awaitTermination()
        got = {(r.id, r.seq): r.state for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
        assert got[1, 1] == "IN_REVIEW" and got[1, 2] == "VERIFIED" and got[1, 3] == want and (9, 1) not in got
