"""Cover density of words in chunks, inside the tasks that hold the chunks, and from an index of words that is kept."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from ..streaming.tables import folder

#: Runs of letters and digits, as in :func:`.search.words`.
_words = re.compile(r"[^\W_]+").findall
#: Parts of a kept index, by a hash of the word; a search reads those of its words.
BUCKETS = 64
#: Rows that a task passes on at once.
HELD = 100_000


def cover_density(places: list) -> float:
    """``r / (1 + r)``, ``r`` adding up, for every shortest stretch that holds all words, one over its length beyond the words.

    ``places``: for each word its places in the text, ascending. A stretch ends where all words have been seen and the last
    place of the one seen longest ago has moved.
    """
    n = len(places)
    if n == 1:
        r = float(len(places[0]))
    else:
        r, start, missing, last = 0.0, -1, n, [-1] * n
        for at, w in sorted((int(at), w) for w, own in enumerate(places) for at in own):
            missing -= last[w] < 0
            last[w] = at
            if not missing and (begin := min(last)) > start:
                r += 1.0 / (at - begin + 2 - n)
                start = begin
    return r / (1 + r)


def scores(queries: pa.Table, chunks: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, lexical_score)`` of the chunks that hold all words of one of ``queries (query_id, w)``; a chunk is read once and nothing moves."""
    names, wanted = queries.column("query_id").to_pylist(), [list(dict.fromkeys(w)) for w in queries.column("w").to_pylist()]
    asking: dict[str, list[int]] = {}
    for q, own in enumerate(wanted):
        for word in own:
            asking.setdefault(word, []).append(q)
    sizes = [len(w) for w in wanted]
    kind = queries.schema.field("query_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, float]] = []

            def done(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([names[q] for q, _, _ in rows], kind), batch.column(0).take(pa.array([i for _, i, _ in rows], pa.int64())), pa.array([s for _, _, s in rows], pa.float64())], names=["query_id", "chunk_id", "lexical_score"])

            for i, lowered in enumerate(batch.column(1)):
                places: dict[str, list[int]] = {}
                for at, word in enumerate(_words(lowered.as_py())):
                    if word in asking:
                        places.setdefault(word, []).append(at)
                held = Counter(q for word in places for q in asking[word])
                rows += [(q, i, cover_density([places[w] for w in wanted[q]])) for q, n in held.items() if n == sizes[q]]
                if len(rows) > HELD:
                    yield done()
                    rows = []
            yield done()

    schema = StructType([StructField("query_id", _type(kind)), chunks.schema["chunk_id"], StructField("lexical_score", DoubleType())])
    return chunks.select("chunk_id", F.lower(F.coalesce("chunk", F.lit(""))).alias("lowered")).mapInArrow(run, schema)


def _type(kind: pa.DataType):
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


def _bucket(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def keep_postings(chunks: DataFrame, buckets: int = BUCKETS) -> str:
    """The folder of an inverted index of ``chunks (chunk_id, chunk)``: for each word the chunks that hold it and its places in each, in parts by word, sorted by word.

    A task passes on one row for a word and many chunks: their ids, how often each has the word, and all places one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, total = None, {}, 0

        def done() -> pa.RecordBatch:
            sizes, ends = [len(ids) for ids, _, _ in held.values()], [len(own) for _, _, own in held.values()]
            bounds = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            columns = [
                pa.array(list(held), pa.string()), pa.ListArray.from_arrays(bounds(sizes), pa.array([x for ids, _, _ in held.values() for x in ids], kind)),
                pa.ListArray.from_arrays(bounds(sizes), pa.array([x for _, n, _ in held.values() for x in n], pa.int32())), pa.ListArray.from_arrays(bounds(ends), pa.array([x for _, _, own in held.values() for x in own], pa.int32())),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "chunk_ids", "counts", "places"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for chunk, lowered in zip(*batch.columns, strict=True):
                places: dict[str, list[int]] = {}
                for n, word in enumerate(_words(lowered.as_py())):
                    places.setdefault(word, []).append(n)
                name = chunk.as_py()
                for word, own in places.items():
                    ids, counts, flat = held.setdefault(word, ([], [], []))
                    ids.append(name)
                    counts.append(len(own))
                    flat += own
                    total += len(own)
                if total > HELD:
                    yield done()
                    total = 0
        if held:
            yield done()

    path = folder(chunks.sparkSession)
    schema = StructType([StructField("word", StringType()), StructField("chunk_ids", ArrayType(chunks.schema["chunk_id"].dataType)), StructField("counts", ArrayType(IntegerType())), StructField("places", ArrayType(IntegerType()))])
    rows = chunks.select("chunk_id", F.lower(F.coalesce("chunk", F.lit(""))).alias("lowered")).mapInArrow(run, schema)
    rows.withColumn("bucket", _bucket("word", buckets)).repartition("bucket", F.pmod(F.xxhash64(F.get("chunk_ids", F.lit(0))), F.lit(8))).sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(path)
    return path


def kept_scores(queries: pa.Table, index: str, spark: SparkSession, key: DataType, buckets: int = BUCKETS) -> DataFrame:
    """As :func:`scores`, for a block of ``queries (query_id, w)``, from an index that :func:`keep_postings` wrote: only the parts of the queries' words are read, and of these only their words.

    A posting is moved once to its chunk, for all queries of the block.
    """
    names, wanted = queries.column("query_id").to_pylist(), [list(dict.fromkeys(w)) for w in queries.column("w").to_pylist()]
    asking: dict[str, list[int]] = {}
    for q, own in enumerate(wanted):
        for word in own:
            asking.setdefault(word, []).append(q)
    sizes, kind, number = [len(w) for w in wanted], queries.schema.field("query_id").type, {word: i for i, word in enumerate(asking)}
    asked = list(asking.values())
    terms = spark.createDataFrame(list(number.items()), "t string, number int").withColumn("b", _bucket("t", buckets))  # words of the block
    parts = sorted(r["b"] for r in terms.select("b").distinct().collect())  # at most ``buckets``
    schema = StructType([StructField("word", StringType()), StructField("chunk_ids", ArrayType(key)), StructField("counts", ArrayType(IntegerType())), StructField("places", ArrayType(IntegerType())), StructField("bucket", IntegerType())])
    rows = spark.read.schema(schema).parquet(index).where(F.col("bucket").isin(parts))
    hits = rows.join(F.broadcast(terms), (F.col("bucket") == F.col("b")) & (F.col("word") == F.col("t"))).select("number", "chunk_ids", "counts", "places")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, counts, places = (row.column(k).flatten() for k in (1, 2, 3))
                ends = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row.column(0)[0].as_py(), np.int32)), ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], names=["number", "chunk_id", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at, score = [], [], []
            for i, every in enumerate(batch.column(1)):
                places = {x["number"]: x["places"] for x in every.as_py()}
                held = Counter(q for n in places for q in asked[n])
                for q, n in held.items():
                    if n == sizes[q]:
                        found.append(names[q])
                        at.append(i)
                        score.append(cover_density([places[number[w]] for w in wanted[q]]))
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column(0).take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], names=["query_id", "chunk_id", "lexical_score"])

    own = hits.mapInArrow(dealt, StructType([StructField("number", IntegerType()), StructField("chunk_id", key), StructField("places", ArrayType(IntegerType()))]))
    held = own.groupBy("chunk_id").agg(F.collect_list(F.struct("number", "places")).alias("every"))  # a list for each word of the block
    return held.mapInArrow(run, StructType([StructField("query_id", _type(kind)), StructField("chunk_id", key), StructField("lexical_score", DoubleType())]))
