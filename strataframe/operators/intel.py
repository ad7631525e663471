"""Keywords, topics and document comparison from chunks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, StringType, TimestampType
from pyspark.sql.window import Window

from .terms import candidates, chunk_terms, first_chunks, ranked_terms, summed_terms


def intelligence_input(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Indexed chunks with the number of their page, or where the page is unknown the number in their metadata.

    ``chunks (chunk_id, page_id, is_indexed, metadata)``, ``pages (page_id, page_number)``.
    """
    joined = chunks.where("is_indexed").join(pages, "page_id", "left")
    return joined.withColumn("page_number", F.coalesce("page_number", F.get_json_object("metadata", "$.page_number").try_cast("int")))


def _ranked(df: DataFrame, keys: tuple[str, ...], limit: int) -> DataFrame:
    """The first ``limit`` by frequency, then term; for each key if there are keys."""
    if not keys:
        return df.orderBy(F.col("frequency").desc(), "term").limit(limit)
    w = Window.partitionBy(*keys).orderBy(F.col("frequency").desc(), "term")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def _frequencies(chunks: DataFrame, by: tuple[str, ...], limit: int, pairs_only: bool) -> DataFrame:
    """``(*by, term, f, t)`` of the terms that can be among the ``limit`` first, summed over tasks."""
    likely, heavy = candidates(chunks, limit, pairs_only=pairs_only)
    rows = summed_terms(chunks, by, pairs_only=pairs_only, likely=likely, heavy=heavy)
    return rows.groupBy(*by, "term").agg(F.sum("f").alias("f"), F.sum("t").alias("t"))


def keywords(chunks: DataFrame, limit: int = 100, keys: tuple[str, ...] = (), page_counts: bool = True) -> DataFrame:
    """Terms by the number of chunks that hold them, with counts of tokens, documents and pages and a weight from 0 to 1.

    ``keys=("document_id",)`` gives each document its own list; its pages are counted for the terms of the lists alone, in a
    pass of their own that ``page_counts=False`` leaves out with their column. Without keys, terms that cannot be among the
    first are found in a pass of their own (:func:`.terms.candidates`) and not shuffled.
    """
    if keys:
        rows = summed_terms(chunks, ("document_id",)).groupBy("document_id", "term").agg(F.sum("f").alias("f"), F.sum("t").alias("t"))
        found = rows.select(*keys, "term", F.col("f").alias("frequency"), F.col("t").alias("token_frequency"), F.lit(1).cast("long").alias("document_count"))
    else:  # a page belongs to one document
        pages = _frequencies(chunks, ("document_id", "page_id"), limit, False)
        documents = pages.groupBy("term", "document_id").agg(F.sum("f").alias("f"), F.sum("t").alias("t"), F.count("page_id").alias("p"))
        found = documents.groupBy("term").agg(F.sum("f").alias("frequency"), F.sum("t").alias("token_frequency"), F.count("document_id").alias("document_count"), F.sum("p").alias("page_count"))
    first = _ranked(found, keys, limit)
    if not keys:
        top = first.agg(F.max("frequency").alias("_top"))
        return first.crossJoin(F.broadcast(top)).withColumn("weight", F.round(F.col("frequency") / F.col("_top"), 6)).drop("_top")  # one row
    first = first.withColumn("weight", F.round(F.col("frequency") / F.max("frequency").over(Window.partitionBy(*keys)), 6))
    if not page_counts:
        return first
    held = chunk_terms(chunks).select(F.col("document_id").alias("_d"), F.col("term").alias("_t"), "page_id")
    lists = first.select("document_id", "term")
    pages = held.join(lists, F.col("_d").eqNullSafe(F.col("document_id")) & (F.col("_t") == F.col("term"))).groupBy("_d", "_t").agg(F.count_distinct("page_id").alias("page_count"))
    joined = first.join(pages, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("term") == F.col("_t")), "left")
    return joined.select(*keys, "term", "frequency", "token_frequency", "document_count", F.coalesce("page_count", F.lit(0)).alias("page_count"), "weight")


#: What evidence says about its chunk, where the chunks have it.
PROVENANCE = ("document_version_id", "page_id", "page_number", "source_unit_id", "evidence_type")
#: Ranked terms that tasks may be given to look for; of more, all terms are joined.
GIVEN = 10_000


#: Columns that a task can order as Spark does.
_ORDERED = (StringType, IntegralType, DecimalType, DateType, TimestampType)


def first_terms(chunks: DataFrame, limit: int = 100, pairs_only: bool = False) -> DataFrame:
    """``(term, frequency)``: the terms of most chunks, or the two-word ones, as ranked by :func:`keywords` and :func:`topics`."""
    (rows,) = ranked_terms(chunks, limit, (pairs_only,))
    return chunks.sparkSession.createDataFrame(rows, "term string, frequency long")  # ``limit`` rows


def _given(ranked: DataFrame) -> list[str] | None:
    """The ranked terms, unless they are too many for tasks to look for."""
    wanted = [r["term"] for r in ranked.select("term").distinct().limit(GIVEN + 1).collect()]
    return wanted if len(wanted) <= GIVEN else None


def _held(chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """:func:`chunk_terms` of the ranked terms, joined."""
    return chunk_terms(chunks).join(ranked.select(F.col("term").alias("_t")).distinct(), F.col("term") == F.col("_t"), "left_semi")


def evidence(chunks: DataFrame, ranked: DataFrame, per_term: int = 5) -> DataFrame:
    """``(term, evidence)``: the first chunks of each ranked term in order of document and chunk, with their provenance.

    Of terms that tasks can look for, a task passes on the first chunks that it has.
    """
    w = Window.partitionBy("term").orderBy("document_id", "chunk_id")
    wanted = _given(ranked)
    in_tasks = wanted is not None and all(isinstance(chunks.schema[c].dataType, _ORDERED) for c in ("document_id", "chunk_id"))
    held = first_chunks(chunks, wanted, per_term) if in_tasks else _held(chunks, ranked)
    first = held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_term)
    known = [c for c in PROVENANCE if c in chunks.columns and c != "page_id"]
    if known:
        first = first.join(chunks.select(F.col("chunk_id").alias("_c"), *known), F.col("chunk_id") == F.col("_c"))
    fields = ["document_id", "chunk_id", *[c for c in PROVENANCE if c in first.columns]]
    return first.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("evidence"))  # ``per_term`` at most


def topics(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """Two-word terms with the share of documents that hold them as confidence."""
    documents = chunks.agg(F.count_distinct("document_id").alias("_n"))
    found = _frequencies(chunks, ("document_id",), limit, True).groupBy("term").agg(F.sum("f").alias("frequency"), F.count("document_id").alias("document_count"))
    return _ranked(found, (), limit).crossJoin(F.broadcast(documents)).select("term", "frequency", "document_count", F.round(F.least(F.lit(1.0), F.col("document_count") / F.greatest(F.col("_n"), F.lit(1))), 6).alias("confidence"))


def distribution(chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(term, document_id, frequency)`` of the ranked topics."""
    wanted = _given(ranked)
    if wanted is None:
        return _held(chunks, ranked).groupBy("term", "document_id").agg(F.count(F.lit(1)).alias("frequency"))
    return summed_terms(chunks, ("document_id",), likely=wanted, occurrences=False).groupBy("term", "document_id").agg(F.sum("f").alias("frequency"))


def topics_for_document(distributed: DataFrame, document_id) -> DataFrame:
    return distributed.where(F.col("document_id") == document_id).select("term", "frequency")


def document_topics(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """Each document's own first topics."""
    rows = summed_terms(chunks, ("document_id",), pairs_only=True, occurrences=False).groupBy("document_id", "term").agg(F.sum("f").alias("frequency"))
    return _ranked(rows, ("document_id",), limit)


def compare_documents(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """``(term, n_documents, total, class)`` over each document's first topics: COMMON to all, else DOCUMENT_SPECIFIC; nothing for fewer than two documents."""
    own = document_topics(chunks, limit)
    n = chunks.agg(F.count_distinct("document_id").alias("_n"))
    found = own.groupBy("term").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("frequency").alias("total"))
    return found.crossJoin(F.broadcast(n)).where("_n > 1").select("term", "n_documents", "total", F.when(F.col("n_documents") == F.col("_n"), "COMMON").otherwise("DOCUMENT_SPECIFIC").alias("class"))


def comparison_status(chunks: DataFrame) -> DataFrame:
    """One row ``(status, numerical_analysis_status, n_documents)``: fewer than two documents cannot be compared, and numbers in texts are never compared."""
    n = chunks.agg(F.count_distinct("document_id").alias("n_documents"))
    return n.select(F.when(F.col("n_documents") < 2, "INSUFFICIENT_EVIDENCE").otherwise("COMPLETED").alias("status"), F.when(F.col("n_documents") >= 2, "INSUFFICIENT_VERIFIED_DATA").alias("numerical_analysis_status"), "n_documents")


def frequency_changes(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """Every topic of the documents compared with its frequency in every one of them, 0 where it is none of its first topics."""
    own = document_topics(chunks, limit).groupBy("term").agg(F.collect_list(F.struct("document_id", "frequency")).alias("_own"))  # a row for each document; texts are searched once
    grid = own.crossJoin(F.broadcast(chunks.select("document_id").distinct()))  # 20 documents at most are compared
    held = F.filter("_own", lambda x: x["document_id"] == F.col("document_id"))
    return grid.select("term", "document_id", F.coalesce(F.get(held, F.lit(0))["frequency"], F.lit(0)).alias("frequency"))


def topic_sets(chunks: DataFrame, a, b, limit: int = 100) -> DataFrame:
    """Topics of two documents as ``BOTH``, ``FIRST`` or ``SECOND``."""
    own = document_topics(chunks.where(F.col("document_id").isin(a, b)), limit)
    return own.groupBy("term").agg(F.max(F.col("document_id") == a).alias("first"), F.max(F.col("document_id") == b).alias("second")).select("term", F.when(F.col("first") & F.col("second"), "BOTH").when(F.col("first"), "FIRST").otherwise("SECOND").alias("side"))


def needs_rebuild(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(document_id, rebuild)``: whether a document's number of chunks differs from that of its finished run ``(document_id, chunk_count)``."""
    now = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_now"))
    return now.join(runs, "document_id", "left").select("document_id", (~F.col("_now").eqNullSafe(F.col("chunk_count"))).alias("rebuild"))


#: Themes in order and the phrases that choose them; the first match wins.
THEMES = (
    ("coal types/products", "raw coal|coking coal|non-coking coal|coal coke"),
    ("resources/geology", "geological resource|coal resource|resources|geology"),
    ("production/dispatch", "production|dispatch"),
    ("stocks", "closing stock|pit-head stock|stock|inventory"),
    ("pricing/royalty/taxes", "price|pricing|royalty|tax"),
    ("captive/commercial blocks", "coal block|captive|commercial block"),
    ("international statistics", "international|world coal|global coal"),
)


def theme(topic: Column) -> Column:
    out = F.when(topic.rlike(f"(?i){THEMES[0][1]}"), THEMES[0][0])
    for name, words in THEMES[1:]:
        out = out.when(topic.rlike(f"(?i){words}"), name)
    return out


def themes(ranked: DataFrame, per_theme: int = 5) -> DataFrame:
    """The first topics of each theme."""
    rows = ranked.withColumn("theme", theme(F.col("term"))).where(F.col("theme").isNotNull())
    w = Window.partitionBy("theme").orderBy(F.col("frequency").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_theme)
