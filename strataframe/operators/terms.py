"""Terms of chunks, counted inside tasks, and the terms that can be among the most frequent ones.

The rules are those of :func:`strataframe.functions.text.terms`. They are applied here to Arrow batches, a chunk at a time:
as column expressions they are lambdas, which Spark interprets, and took some ten times as long.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import NOISE, STOP_WORDS, TOKEN

_tokens, _noise, _stops = re.compile(TOKEN).findall, re.compile(rf"(?:{NOISE})\Z").match, frozenset(STOP_WORDS)
#: A task passes its counts on when it holds so many, and knows so many tokens.
HELD, KNOWN = 150_000, 100_000
#: Bins that tokens, and as many that pairs are counted in, chunks of the sample, and likely terms of each sort for each term wanted.
BINS, SAMPLE, LIKELY = 1 << 16, 2000, 10


class _Known(dict):
    """Whether a token means something."""

    def __missing__(self, token: str) -> bool:
        if len(self) > KNOWN:
            self.clear()
        found = self[token] = token not in _stops and not _noise(token)
        return found


def listed(lowered: str, fine: _Known, pairs_only: bool = False) -> list[str]:
    """Terms of a text in lower case: meaningful tokens, and pairs of different ones side by side."""
    every = _tokens(lowered)
    flags = [fine[t] for t in every]
    pairs = [f"{a} {b}" for a, b, x, y in zip(every, every[1:], flags, flags[1:], strict=False) if x and y and a != b]
    return pairs if pairs_only else [*compress(every, flags), *pairs]


def counted(lowered: str, fine: _Known, pairs_only: bool = False) -> Counter:
    """Terms of a text with their occurrences."""
    return Counter(listed(lowered, fine, pairs_only))


def distinct(lowered: str, fine: _Known, pairs_only: bool = False) -> tuple[set[str], set[str]]:
    """The different terms of :func:`listed`: tokens, and pairs."""
    every = [t if fine[t] else None for t in _tokens(lowered)]
    pairs = {f"{a} {b}" for a, b in set(zip(every, every[1:], strict=False)) if a and b and a != b}
    return set() if pairs_only else set(filter(None, every)), pairs


def _looked_for(wanted: Collection[str]) -> Callable[[str], set[str]]:
    """What finds those of the terms ``wanted`` that :func:`listed` would find in a text."""
    fine = _Known()
    parts = [t.split(" ") for t in wanted]
    parts = [p for p in parts if all(_tokens(t) == [t] and fine[t] for t in p)]
    tokens, pairs = {p[0] for p in parts if len(p) == 1}, {(p[0], p[1]) for p in parts if len(p) == 2 and p[0] != p[1]}
    firsts = {a for a, _ in pairs}

    def look(lowered: str) -> set[str]:
        every = _tokens(lowered)
        found = tokens.intersection(every)
        found.update([f"{a} {b}" for a, b in zip(every, every[1:], strict=False) if a in firsts and (a, b) in pairs])
        return found

    return look


def _run(chunks: DataFrame, keys: tuple[str, ...], text: str, added: list[StructField], work: Callable) -> DataFrame:
    lowered = chunks.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_lowered"))
    schema = StructType([*[chunks.schema[k] for k in keys], *added])
    return lowered.mapInArrow(work, schema)


def chunk_terms(chunks: DataFrame, text: str = "text", pairs_only: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """``(document_id, page_id, chunk_id, term, n)``: terms of every chunk, counted; of the terms ``only`` if given. Nothing moves."""
    keys, wanted = ("document_id", "page_id", "chunk_id"), None if only is None else frozenset(only)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine = _Known()
        for batch in batches:
            at, terms, n = [], [], []

            def done(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(3)], pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=[*keys, "term", "n"])

            for i, lowered in enumerate(batch.column(3)):
                found = counted(lowered.as_py(), fine, pairs_only)
                if wanted is not None:
                    found = {t: found[t] for t in found.keys() & wanted}
                at += [i] * len(found)
                terms += found.keys()
                n += found.values()
                if len(at) > HELD:
                    yield done()
                    at, terms, n = [], [], []
            yield done()

    return _run(chunks, keys, text, [StructField("term", StringType()), StructField("n", LongType())], work)


def summed_terms(chunks: DataFrame, keys: tuple[str, ...], text: str = "text", pairs_only: bool = False, likely: Collection[str] | None = None, heavy: Collection[int] = (), occurrences: bool = True) -> DataFrame:
    """``(*keys, term, f, t)``: the chunks that hold a term and its occurrences, added up for each task; to be added up over tasks.

    With ``likely``, only these terms and those whose bin is one of ``heavy``. Without ``occurrences`` there is no ``t``, and
    each different term of a chunk is held once.
    """
    wanted, bins = None if likely is None else frozenset(likely), frozenset(heavy)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine, held, total = _Known(), {}, 0
        look = None if wanted is None or bins or occurrences else _looked_for(wanted)

        def done(schema: pa.Schema) -> pa.RecordBatch:
            sizes = [len(f) for f, _ in held.values()]
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [pa.array([key[i] for key in held], schema.field(i).type).take(at) for i in range(len(keys))]
            terms, f = pa.array([x for f, _ in held.values() for x in f], pa.string()), pa.array([n for f, _ in held.values() for n in f.values()], pa.int64())
            t = [pa.array([t[x] for f, t in held.values() for x in f], pa.int64())] if occurrences else []
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, terms, f, *t], names=[*keys, "term", "f", *(["t"] if occurrences else [])])

        batch = None
        for batch in batches:
            for *key, lowered in zip(*batch.columns, strict=True):
                if look:
                    found = look(lowered.as_py())
                elif occurrences:
                    found = listed(lowered.as_py(), fine, pairs_only)
                else:
                    found = set().union(*distinct(lowered.as_py(), fine, pairs_only))
                if wanted is not None and not look:
                    found = [t for t in found if t in wanted or (bins and _bin(t) in bins)]
                f, t = held.setdefault(tuple(k.as_py() for k in key), (Counter(), Counter()))
                total -= len(f)
                f.update(set(found) if occurrences else found)
                if occurrences:
                    t.update(found)
                total += len(f)
                if total > HELD:
                    yield done(batch.schema)
                    total = 0
        if batch is not None:
            yield done(batch.schema)

    return _run(chunks, keys, text, [StructField("term", StringType()), StructField("f", LongType()), *([StructField("t", LongType())] if occurrences else [])], work)


def first_chunks(chunks: DataFrame, only: Collection[str], per_term: int, text: str = "text") -> DataFrame:
    """``(document_id, page_id, chunk_id, term)``: for each of the terms ``only`` the first chunks that a task has, in order of document and chunk, nulls first."""
    keys, wanted = ("document_id", "page_id", "chunk_id"), frozenset(only)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, first, schema = _looked_for(wanted), {}, None
        for batch in batches:
            schema = batch.schema
            for document, page, chunk, lowered in zip(*batch.columns, strict=True):
                found = look(lowered.as_py())
                if not found:
                    continue
                d, p, c = document.as_py(), page.as_py(), chunk.as_py()
                order = (d is not None, d, c is not None, c)
                for term in found:
                    own = first.setdefault(term, [])
                    if len(own) < per_term or order < own[-1][0]:
                        insort(own, (order, p), key=lambda x: x[0])
                        del own[per_term:]
        if schema is not None:
            rows = [(o[1], p, o[3], term) for term, own in first.items() for o, p in own]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], schema.field(i).type if i < 3 else pa.string()) for i in range(4)], names=[*keys, "term"])

    return _run(chunks, keys, text, [StructField("term", StringType())], work)


def _bin(term: str) -> int:
    return zlib.crc32(term.encode()) % BINS + BINS * (" " in term)


def _first_of_each(found: DataFrame, limit: int) -> dict[str, int]:
    """The ``limit`` first tokens and pairs of ``found (term, f)`` by ``f``, then by themselves."""
    w = Window.partitionBy(F.contains("term", F.lit(" "))).orderBy(F.desc("f"), "term")
    return {r["term"]: r["f"] for r in found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).collect()}


def _bounds(chunks: DataFrame, limit: int, text: str, pairs_only: bool) -> tuple[dict[str, int], dict[int, int]]:
    """The chunks of likely terms, exactly, and the sum over all other terms of each bin."""
    share = F.shiftrightunsigned(F.xxhash64("chunk_id"), 11).cast("double") * 2.0**-53
    n = chunks.count()
    sample = chunks.where(share * n < SAMPLE) if n > SAMPLE else chunks
    likely = frozenset(_first_of_each(summed_terms(sample, (), text, pairs_only, occurrences=False).groupBy("term").agg(F.sum("f").alias("f")), LIKELY * limit))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine, bins, exact = _Known(), np.zeros((2, BINS), np.int64), Counter()
        for batch in batches:
            for lowered in batch.column(0):
                for found, own in zip(distinct(lowered.as_py(), fine, pairs_only), bins, strict=True):
                    exact.update(found & likely)
                    at = [zlib.crc32(t.encode()) for t in found - likely]
                    if at:
                        np.add.at(own, np.array(at, np.int64) % BINS, 1)
        bins = bins.ravel()
        some = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), *[None] * len(exact)], pa.int64()), pa.array([*[None] * len(some), *exact], pa.string()), pa.array([*bins[some].tolist(), *exact.values()], pa.int64())], names=["bin", "term", "f"])

    counts = _run(chunks, (), text, [StructField("bin", LongType()), StructField("term", StringType()), StructField("f", LongType())], work).groupBy("bin", "term").agg(F.sum("f").alias("f")).collect()
    return {r["term"]: r["f"] for r in counts if r["term"] is not None}, {r["bin"]: r["f"] for r in counts if r["term"] is None}


def _floor(counts: Collection[int], limit: int) -> int:
    """What a term has to reach to be among the ``limit`` first."""
    return sorted(counts, reverse=True)[limit - 1] if len(counts) >= limit else 1


def candidates(chunks: DataFrame, limit: int, text: str = "text", pairs_only: bool = False) -> tuple[list[str], list[int]]:
    """Terms and bins that hold the ``limit`` terms of most chunks, without shuffling the others.

    A sample of some thousand chunks names likely terms. One pass counts these, and for all other terms the bins that they
    hash to. The ``limit``-th largest count of a likely term bounds the answer from below, so neither a likely term of a
    smaller count nor any term of a lighter bin can be in it. The driver gets a count for each bin and likely term.
    """
    exact, bins = _bounds(chunks, limit, text, pairs_only)
    floor = _floor(exact.values(), limit)
    return [t for t, f in exact.items() if f >= floor], [b for b, f in bins.items() if f >= floor]


def ranked_terms(chunks: DataFrame, limit: int, kinds: tuple[bool, ...] = (False,), text: str = "text") -> list[list[tuple[str, int]]]:
    """For each of ``kinds`` (whether pairs alone count) the ``limit`` terms of most chunks and how many hold them, by that, then by themselves.

    As in :func:`candidates`, for all kinds at once. The pass that bounds the terms has counted the likely ones, so texts are
    searched again only where some bin is as heavy as a term of an answer, and then for the terms of these bins.
    """
    exact, bins = _bounds(chunks, limit, text, all(kinds))
    floors = {kind: _floor([f for t, f in exact.items() if " " in t or not kind], limit) for kind in kinds}
    heavy = {b for b, f in bins.items() if any(f >= floor and (b >= BINS or not kind) for kind, floor in floors.items())}
    if heavy:
        exact |= _first_of_each(summed_terms(chunks, (), text, all(kinds), (), heavy, occurrences=False).groupBy("term").agg(F.sum("f").alias("f")), limit)
    return [sorted(((t, f) for t, f in exact.items() if " " in t or not kind), key=lambda x: (-x[1], x[0]))[:limit] for kind in kinds]
