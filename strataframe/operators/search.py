"""Semantic, lexical and hybrid search of many queries at once, and evidence for answers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .postings import kept_scores, scores

SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 0.7, 0.3
MAX_TOP_K, MAX_QUERY_CHARS, CONTEXT_CHARS = 50, 1000, 24_000
#: Query vectors that are broadcast at once; more are scored block by block.
BROADCAST_QUERIES = 20_000
#: Query vectors that a task scores at once.
TASK_QUERIES = 2000

# The words that route a question.
CALCULATION = r"(?i)\b(total|sum|average|mean|percentage|percent|how many|how much|distance|reserve|growth rate|production rate)\b"
TRUSTED = r"(?i)\b(verified|trusted|canonical|recorded)\b"
DOMAIN = r"(?i)\b(production|mine|project|borehole|seam|block)\b"
SOURCE = r"(?i)\b(source|document|report|page|text|according to)\b"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"top-k is 1 to {MAX_TOP_K}")
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, semantic_score)`` of every indexed chunk for ``queries (query_id, vector)``.

    Each chunk's norm is taken once. Queries are a stated set: it is broadcast against all chunks in blocks.
    """
    return reduce(DataFrame.unionByName, [_scored(block, chunks) for block in _blocks(queries)])


def _blocks(queries: DataFrame, most: int = 0) -> list[DataFrame]:
    """``queries`` in parts that may be broadcast, by a hash of their ids."""
    most = most or BROADCAST_QUERIES
    n = queries.count()
    parts = 1 if n <= most else -(-2 * n // most)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries for i in range(parts)]


def _unit(v: Column) -> Column:
    """A vector over its length; null for a vector of no length."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def _dot(q: str, c: str) -> Column:
    return F.aggregate(F.zip_with(q, c, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _scored(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    q = queries.select("query_id", _unit(F.col("vector")).alias("q"))
    c = chunks.where(F.col("is_indexed") & F.col("embedding").isNotNull()).select("chunk_id", _unit(F.col("embedding")).alias("c"))
    return c.crossJoin(F.broadcast(q)).select("query_id", "chunk_id", _dot("q", "c").alias("semantic_score"))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexical_scores(queries: DataFrame, chunks: DataFrame, index: str | None = None) -> DataFrame:
    """``(query_id, chunk_id, lexical_score)`` of the chunks that hold all words of ``queries (query_id, query)``.

    Cover density: every shortest stretch that holds all words adds one over its length beyond the words; the sum ``r`` is
    squashed to ``r / (1 + r)``. Chunks are scored in the tasks that read them, for a block of queries at a time. With an
    ``index`` that :func:`.postings.keep_postings` wrote, only the postings of the queries' words are read.
    """
    if queries.where(F.length("query") > MAX_QUERY_CHARS).limit(1).count():
        raise ValueError(f"a query has at most {MAX_QUERY_CHARS} characters")
    wanted = queries.select("query_id", words(F.col("query")).alias("w")).where(F.size("w") > 0)
    blocks = [block.toArrow() for block in _blocks(wanted, TASK_QUERIES)]  # each of at most so many
    if index is not None:
        key = chunks.schema["chunk_id"].dataType
        return reduce(DataFrame.unionByName, [kept_scores(block, index, chunks.sparkSession, key) for block in blocks])
    return reduce(DataFrame.unionByName, [scores(block, chunks) for block in blocks])


def _units(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their length, and which of them have one: others have no score."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out, fine = np.zeros((len(vectors), dim)), lengths == dim
    some = vectors.filter(pa.array(fine)).flatten()
    if len(some):
        out[fine] = some.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null becomes NaN
    size = np.sqrt((out * out).sum(1))
    fine &= np.isfinite(size) & (size > 0)
    out[~fine] = 0
    return out / np.where(fine, size, 1)[:, None], fine


def _best_in_task(queries: pa.Table, k: int):
    """What a task does for a block of queries: its ``k`` best chunks for each, ties by id, chunks without a score last."""
    names = queries.column("query_id").to_pylist()
    vectors = queries.column("vector").combine_chunks()
    dims = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    groups = [(d, np.flatnonzero(dims == d)) for d in np.unique(dims).tolist()]
    ready = [(at, *_units(vectors.take(pa.array(at)), max(d, 0)), max(d, 0)) for d, at in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in names]
        kind = None
        for batch in batches:
            ids, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.schema.field(0).type
            order = np.argsort(ids, kind="stable")
            for at, unit, usable, dim in ready:
                chunk, fine = _units(batch.column(1), dim)
                score = np.round(unit @ chunk.T, 12)
                score[~usable] = -np.inf
                score[:, ~fine] = -np.inf
                if len(ids) > k:
                    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    least = np.full(len(at), -np.inf)
                for i, q in enumerate(at.tolist()):
                    own = best[q]
                    floor = max(least[i], -own[-1][0]) if len(own) == k else least[i]
                    row = score[i, order]
                    hit = np.flatnonzero(row >= floor)
                    if len(hit) > k:  # ties: the first by id of the best
                        hit = hit[np.argsort(-row[hit], kind="stable")[:k]]
                    best[q] = sorted(own + [(-s, x) for s, x in zip(row[hit].tolist(), ids[order[hit]].tolist(), strict=True)])[:k]
        if kind is not None:
            rows = [(names[q], x, None if s == np.inf else -s) for q, own in enumerate(best) for s, x in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], queries.schema.field("query_id").type), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "chunk_id", "score"])

    return run


def semantic_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Best ``k`` by meaning: scores of one block of queries after another with all chunks, in matrices inside the tasks.

    A task passes on ``k`` rows for each query at most. Scores that agree to twelve places are ties and go by chunk id.
    """
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"top-k is 1 to {MAX_TOP_K}")
    own = chunks.where(F.col("is_indexed") & F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", chunks.schema["chunk_id"].dataType), StructField("score", DoubleType())])
    blocks = [block.select("query_id", "vector").toArrow() for block in _blocks(queries, TASK_QUERIES)]  # each of at most so many
    return reduce(DataFrame.unionByName, [_top(own.mapInArrow(_best_in_task(block, k), schema), k) for block in blocks])


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int, pad: bool = False, index: str | None = None) -> DataFrame:
    """Best ``k`` by words, those of ``chunks`` or of a kept index of them; ``pad`` fills up with chunks of no score in the order of their ids."""
    best = _top(lexical_scores(queries, chunks, index).withColumnRenamed("lexical_score", "score"), k)
    if not pad:
        return best
    spare = chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k)  # whatever is found, k of these are not
    fill = queries.select("query_id").crossJoin(F.broadcast(spare)).join(best.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return _top(best.select("query_id", "chunk_id", "score").unionByName(fill), k)


def hybrid_topk(queries: DataFrame, chunks: DataFrame, k: int, semantic: float = SEMANTIC_WEIGHT, lexical: float = LEXICAL_WEIGHT) -> DataFrame:
    """Best ``k`` by both scores, weights made to add up to one.

    A chunk without the query's words is among the best only if it is among the ``k`` best by meaning, so these and the
    chunks with the words are all that is ranked; no other pair leaves its task.
    """
    total = semantic + lexical
    best = semantic_topk(queries.select("query_id", "vector"), chunks, k).select("query_id", "chunk_id", F.col("score").alias("semantic_score"), F.lit(None).cast("double").alias("lexical_score"))
    vectors = chunks.where(F.col("is_indexed") & F.col("embedding").isNotNull()).select(F.col("chunk_id").alias("_c"), _unit(F.col("embedding")).alias("_cv"))
    hits = lexical_scores(queries.select("query_id", "query"), chunks).join(vectors, F.col("chunk_id") == F.col("_c")).join(queries.select(F.col("query_id").alias("_q"), _unit(F.col("vector")).alias("_qv")), F.col("query_id") == F.col("_q"))
    hits = hits.select("query_id", "chunk_id", _dot("_qv", "_cv").alias("semantic_score"), "lexical_score")
    rows = best.unionByName(hits).groupBy("query_id", "chunk_id").agg(F.max("semantic_score").alias("semantic_score"), F.max("lexical_score").alias("lexical_score"))
    score = F.coalesce("semantic_score", F.lit(0.0)) * (semantic / total) + F.coalesce("lexical_score", F.lit(0.0)) * (lexical / total)
    return _top(rows.withColumn("score", score), k)


def filter_chunks(chunks: DataFrame, document_id=None, version_id=None, page_id=None, content_type=None, evidence_types=None, entity_type=None, created_from=None, created_before=None) -> DataFrame:
    """The filters that are given; the date range is open at its end."""
    for name, want in (("document_id", document_id), ("document_version_id", version_id), ("page_id", page_id), ("content_type", content_type)):
        if want is not None:
            chunks = chunks.where(F.col(name) == want)
    if evidence_types:
        chunks = chunks.where(F.col("evidence_type").isin(*evidence_types))
    if entity_type:
        chunks = chunks.where(F.get_json_object("metadata", "$.entity_type") == entity_type.upper())
    if created_from is not None:
        chunks = chunks.where(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_before is not None:
        chunks = chunks.where(F.col("created_at") < F.lit(created_before).cast("timestamp"))
    return chunks


def chunk_context(hits: DataFrame, chunks: DataFrame, documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Hits with their chunk, document and, where there is one, page."""
    out = hits.join(chunks, "chunk_id").join(documents, "document_id")
    return out.join(pages, "page_id", "left") if pages is not None else out


def traceable(hits: DataFrame) -> DataFrame:
    """Hits with a document, a version and a source unit, and these as ``provenance``."""
    ids = ("document_id", "document_version_id", "source_unit_id", "chunk_id")
    return hits.where(" AND ".join(f"{c} IS NOT NULL" for c in ids)).withColumn("provenance", F.struct(*ids))


def needs_trusted(question: Column) -> Column:
    """Asks for verified data, or for a thing of the trade without naming a source."""
    return question.rlike(TRUSTED) | (question.rlike(DOMAIN) & ~question.rlike(SOURCE))


def route_questions(df: DataFrame, text: str = "text") -> DataFrame:
    q = F.trim(F.regexp_replace(text, r"\s+", " "))
    return df.withColumns({"normalized": q, "valid": F.length(q).between(1, MAX_QUERY_CHARS), "trusted_requested": needs_trusted(q), "calculation": q.rlike(CALCULATION), "mentions_source": q.rlike(SOURCE)})


def analysis_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Whether a question is about numbers or about places."""
    return df.withColumns({"numeric": F.col(text).rlike(r"(?i)\b(production|output|total|average|trend|growth|tonnes?|compare)\b"), "spatial": F.col(text).rlike(r"(?i)\b(near|nearest|distance|location|coordinates?|map|within|spatial)\b")})


def trusted_first(hits: DataFrame, k: int) -> DataFrame:
    """Hits of each query with trusted ones first, cut to ``k`` and numbered."""
    w = Window.partitionBy("query_id").orderBy(F.col("evidence_type") != "TRUSTED_CANONICAL_DATA", F.col("score").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label(hits: DataFrame) -> DataFrame:
    return hits.withColumn("citation_id", F.concat(F.lit("E"), F.col("rank")))


def pack_context(hits: DataFrame, text: str = "chunk", budget: int = CONTEXT_CHARS) -> DataFrame:
    """Hits in rank order as far as the budget of characters goes; the last is cut to what is left."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    out = hits.withColumn("_left", budget - used).where(F.col("_left") > 0)
    return out.withColumn("context", F.substring(F.col(text), F.lit(1), F.col("_left").cast("int"))).drop("_left")


def check_citations(answers: DataFrame, text: str = "answer", allowed: str = "allowed", no_digits: bool = False) -> DataFrame:
    """``citations_ok``: at least one ``[En]``, all of them allowed; ``no_digits`` refuses other digits."""
    cited = F.regexp_extract_all(F.col(text), F.lit(r"\[(E\d+)\]"), F.lit(1))
    ok = (F.size(cited) > 0) & (F.size(F.array_except(cited, F.col(allowed))) == 0)
    if no_digits:
        ok = ok & ~F.regexp_replace(text, r"\[E\d+\]", "").rlike(r"\d")
    return answers.withColumn("citations_ok", F.coalesce(ok, F.lit(False)))


def question_status(questions: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """INSUFFICIENT_EVIDENCE without hits, DETERMINISTIC_CALCULATION_REQUIRED for sums and the like, else EVIDENCE_ONLY."""
    n = hits.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("n_hits"))
    joined = questions.join(n, F.col("query_id") == F.col("_q"), "left").drop("_q").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("n_hits") == 0, "INSUFFICIENT_EVIDENCE").when(F.col(text).rlike(CALCULATION), "DETERMINISTIC_CALCULATION_REQUIRED").otherwise("EVIDENCE_ONLY"))


def fallback_answer(hits: DataFrame, text: str = "chunk", chars: int = 1200) -> DataFrame:
    """``(query_id, answer)``: the labelled beginnings of a query's hits."""
    part = F.concat(F.lit("[E"), F.col("rank"), F.lit("] "), F.substring(F.col(text), 1, chars))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank"), part.alias("part")))), lambda x: x["part"]), "\n\n").alias("answer"))


def search_audit(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("result_ids"), F.lit("COMPLETED").alias("status"))


def with_evidence(hits: DataFrame, pages: DataFrame, contents: DataFrame, cells: DataFrame, budget: int = CONTEXT_CHARS, units: int = 10, unit_chars: int = 4000) -> DataFrame:
    """``exact_source_text`` of each hit: its chunk, its page's text, the page's first content units without the hit's own, and its table row's cells; repeats dropped, cut to the budget.

    ``pages (page_id, page_text)``, ``contents (page_id, unit_id, unit_text, unit_order)``, ``cells (table_id, row_index, column_index, cell_text)``; hits have ``page_id, source_unit_id`` and, for table rows, ``table_id, row_index``.
    """
    w = Window.partitionBy("page_id").orderBy("unit_order", "unit_id")
    first = contents.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= units)
    by_page = first.groupBy(F.col("page_id").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("_r", "unit_id", F.substring("unit_text", 1, unit_chars).alias("t")))).alias("_units"))
    by_row = cells.groupBy(F.col("table_id").alias("_t"), F.col("row_index").alias("_i")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_index", "cell_text"))), lambda x: x["cell_text"]), " | ").alias("_row"))
    joined = hits.join(pages.withColumnRenamed("page_id", "_pp"), F.col("page_id") == F.col("_pp"), "left").join(by_page, F.col("page_id") == F.col("_p"), "left").join(by_row, (F.col("table_id") == F.col("_t")) & (F.col("row_index") == F.col("_i")), "left")
    others = F.transform(F.filter(F.coalesce("_units", F.array()), lambda u: ~u["unit_id"].eqNullSafe(F.col("source_unit_id"))), lambda u: u["t"])
    parts = F.filter(F.concat(F.array("chunk", "page_text"), others, F.array("_row")), lambda x: x.isNotNull() & (x != ""))
    return joined.withColumn("exact_source_text", F.substring(F.array_join(F.array_distinct(parts), "\n"), 1, budget)).drop("_pp", "_p", "_units", "_t", "_i", "_row")
