"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A seed is a mask over consecutive tokens: ``1`` takes the token into the hash, ``0`` ignores it, so two passages share a
seed although tokens at ignored places were replaced. Hashes of all document positions are joined with hashes of all
benchmark positions; around each hit the two texts are laid over each other and the passage is verified by counting equal
tokens in every window of the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept

#: Six tokens each; every pattern of one replaced token in five leaves one of them whole.
MASKS = ("1110111", "11011011", "111100011", "1010110011")
#: Benchmark hashes that may be broadcast (16 bytes of data each, at most 100 MB with the hash table).
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens: runs of letters and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda x: F.xxhash64(x))


def _seeds(words: str, at: str, masks: tuple[str, ...]) -> Column:
    """The seed hashes at a position, null where a mask runs over the end."""
    out = []
    for m, mask in enumerate(masks):
        own = [F.get(F.col(words), F.col(at) + i) for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(F.col(at) + len(mask) <= F.size(words), F.xxhash64(F.lit(m), *own)))
    return F.array(*out)


def _exploded(df: DataFrame, words: str, at: str, seed: str, masks: tuple[str, ...]) -> DataFrame:
    shortest = min(map(len, masks))
    placed = df.where(F.size(words) >= shortest).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(words) - shortest)))
    return placed.withColumn(seed, F.explode(_seeds(words, at, masks))).where(F.col(seed).isNotNull())


def _equal(i: Column) -> Column:
    """1 where the texts have equal tokens at place ``i`` of their overlap."""
    return (F.get(F.col("words"), F.col("doc_start") + i) == F.get(F.col("item_words"), F.col("item_start") + i)).cast("int")


def _best_window() -> Column:
    """The most equal tokens in any window of ``span`` tokens of the overlap."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        now = acc["now"] + _equal(i) - F.when(i >= F.col("span"), _equal(i - F.col("span"))).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.col("n_overlap") - 1), start, step)["best"]


def _row(key: str, text: str) -> list[Column]:
    """128 bits that stand for a row."""
    return [F.xxhash64(key, text).alias("row"), F.xxhash64(F.lit(1), key, text).alias("row2")]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, window: int = 13, share: float = 0.75) -> DataFrame:
    """``(row, row2, key, item, n_equal, shift, n_overlap, best_window, doc_start, item_start)``: every row of ``docs`` laid over every item that shares a passage with it, once for each shift.

    First the seeds alone are joined, and each (row, item, shift) is kept once in the shared folder, whatever its number
    of hits; then the texts of the rows found are read again and verified. A benchmark of few seeds is broadcast, which
    bounds its words too; the rows found are left to Spark's own size check.
    """
    d = docs.select(*_row(key, text), F.col(key).alias("key"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), F.xxhash64(item, item_text).alias("item_row"), tokens(F.col(item_text)).alias("item_words")).dropDuplicates(["item_row"])
    items = items.where(F.size("item_words") >= min(map(len, masks)))
    seeds = _exploded(items, "item_words", "item_at", "item_seed", masks).select(F.col("item_row").alias("own"), "item_at", "item_seed")
    small = F.broadcast if seeds.count() <= BROADCAST_SEEDS else lambda x: x
    hashed = _exploded(d.select("row", "row2", tokens(F.col("text")).alias("words")), "words", "at", "seed", masks).select("row", "row2", "at", "seed")
    hits = hashed.join(small(seeds), F.col("seed") == F.col("item_seed")).select(F.col("row").alias("hit"), F.col("row2").alias("hit2"), "own", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = kept(hits.distinct(), "hits")
    laid = d.join(hits, (F.col("row") == F.col("hit")) & (F.col("row2") == F.col("hit2"))).withColumn("words", tokens(F.col("text"))).drop("text", "hit", "hit2")
    laid = laid.join(small(items), F.col("own") == F.col("item_row")).withColumn("item_start", F.greatest(F.lit(0), -F.col("shift")))
    laid = laid.withColumns({"doc_start": F.col("item_start") + F.col("shift"), "n_overlap": F.least(F.size("item_words"), F.size("words") - F.col("shift")) - F.col("item_start"), "span": F.least(F.lit(window), F.size("item_words"))})
    found = laid.withColumn("best_window", _best_window()).where(F.col("best_window") >= F.ceil(F.lit(share) * F.col("span")))
    equal = F.aggregate(F.sequence(F.lit(0), F.col("n_overlap") - 1), F.lit(0), lambda acc, i: acc + _equal(i))
    return found.select("row", "row2", "key", "item", equal.alias("n_equal"), "shift", "n_overlap", "best_window", "doc_start", "item_start")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """``(key, item, n_equal, n_overlap, best_window, doc_start, item_start)``: one row for each document and benchmark item with a shared passage.

    A passage counts when some window of ``window`` tokens (the whole item where it is shorter) has at least ``share`` of
    its tokens equal at equal places; ``n_equal`` of ``n_overlap`` tokens are equal where the texts lie over each other
    best (of ties the smaller shift). Null or short texts (fewer tokens than a mask) match nothing. Repeated documents and
    items give one row for each key and item id, null ones included. Empty tables give an empty result. Names of the two
    tables may clash; other columns play no part.
    """
    best = matches(docs, benchmark, key, text, item, **options).groupBy("key", "item").agg(F.max(F.struct("n_equal", -F.col("shift"), "n_overlap", "best_window", "doc_start", "item_start")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "m.n_equal", "m.n_overlap", "m.best_window", "m.doc_start", "m.item_start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text shares a passage with the benchmark; all their columns, of whatever names, are kept.

    Rows are removed by what they hold, so rows of a null key go like others, and of two rows with one key only the one
    with the passage. Null, empty and short texts stay. An empty benchmark removes nothing.
    """
    a, b = fresh(docs, "bad_a"), fresh(docs, "bad_b")
    bad = kept(matches(docs, benchmark, key, text, **options).select(F.col("row").alias(a), F.col("row2").alias(b)).distinct(), "leaks")
    own = _row(key, text)
    return docs.join(bad, (own[0] == F.col(a)) & (own[1] == F.col(b)), "left_anti")
