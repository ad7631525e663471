"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontaminate, language, lines, packing, queries, simhash
from strataframe.llm.common import discard, new_folder

#: A language has to be likelier than all others together.
LEAST_SCORE = 0.5
#: Texts are near-duplicates when their sets of five-word shingles overlap by this many hundredths of their union.
SHINGLE, PERCENT = 5, 80
#: Rows of whole texts that Spark passes to a Python worker at once.
BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to :data:`BATCH` rows, unless the session already has smaller ones: both sides hold a batch at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH:
        spark.conf.set(name, BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null, empty, without letters or of no certain language go.

    Repeated rows are judged alike. Without any labelled text every document goes. An empty table stays empty.
    """
    _small_batches(spark)
    known = language.identify(docs, language.fit(docs), label="lang_pred_", score="lang_score_")
    return known.where((F.col("lang_pred_") != "und") & (F.col("lang_score_") >= LEAST_SCORE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; copies of a document count as one, for they are still there.

    No document goes. Null and empty texts stay as they are; a null source is a source of its own.
    """
    _small_batches(spark)
    out = lines.drop_boilerplate_lines(docs, host="source", max_ratio=queries.LINE_RATIO, least=queries.LINE_PAGES, copies_once=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id, null last; of repeated rows one.

    Null, empty and blank texts are near-duplicates of each other. Documents of one id but different texts are judged each
    by its text. An empty table stays empty.
    """
    _small_batches(spark)
    return simhash.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark. Null, empty and short texts stay; null ids are judged like others."""
    _small_batches(spark)
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 ids; a null or empty text is one piece of one id."""
    _small_batches(spark)
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), queries.END, 1024)


STAGES = [("language_id", identify_language), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]

#: The stages learn, hash and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows are kept in the shared folder until the next one's are written."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
