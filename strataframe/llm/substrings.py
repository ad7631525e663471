"""Substring deduplication by level-wise doubling.

A passage of ``2 n`` words repeats only if the passages of ``n`` words inside it repeat. The first level looks at windows of
half ``window``, and only at those that content chooses: the one of least hash in every ``window`` words. Windows that occur
in two texts are extended to ``window`` words; of these the repeated ones alone to twice the length, and so on until no
candidate survives.

Texts are written once, in compressed chunks of some megabytes, as a table bucketed by chunk, and never move again: every
level reads them in place. A chunk settles by itself what it can and sends each different hash of a level once, sorted and
packed, one small row for each range of hashes; the answer tells it which of them other chunks have. So a window that a
third of all texts share is one entry a chunk, and a level is one exchange of a few bytes a window.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, new_folder

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text in a chunk at least (or all of a task's), and hashes that a task compares at once, about.
CHUNK, BUCKET = 8 << 20, 2_000_000
LARGEST = 2**63 - 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word of all texts, in order, and the number of words of each text."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(words))), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy(), counts


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` words, by doubling: two windows of one length give one of up to twice that."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    have, h = 1, _finish(words + _BASE)
    while have < n:
        step = min(have, n - have)  # the second window may overlap the first
        h = _finish(h[:-step] * _BASE + (h[step:] ^ (h[step:] >> np.uint64(29))) + np.uint64(have + step))
        have += step
    return h


def _inside(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all windows of ``n`` words that lie in one text, and their texts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(owner)) + n <= np.cumsum(counts)[owner])
    return at, owner[at]


def least_inside(words: np.ndarray, window: int, short: int) -> np.ndarray:
    """For every place, the least hash of a window of ``short`` words in the ``window`` words from there on."""
    low, have, per = window_hashes(words, short), 1, window - short + 1
    while have < per and len(low):
        step = min(have, per - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _new_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte in planes, compressed; the first one is ascending and kept as differences."""
    columns = (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])
    parts = [struct.pack("<cI", c.dtype.char.encode(), len(c)) + np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<cI", raw, at)
        dtype = np.dtype(kind.decode())
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * dtype.itemsize, at + 5).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += 5 + n * dtype.itemsize
    return [np.cumsum(out[0], dtype=out[0].dtype), *out[1:]]


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """``rows (key, nul, a, b, text)`` in chunks: ``(chunk, keys, nuls, a, b, sizes, z)``, kept in the shared folder in buckets by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, have, held = TaskContext.get().partitionId(), 0, 0, []
        names = ["chunk", "keys", "nuls", "a", "b", "sizes", "z"]

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column(4).cast(pa.binary()).to_pylist()
            lists = [pa.array([table.column(i).to_pylist()], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
            z = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *lists, pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([z], pa.binary())], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                held.append(batch.slice(lo, 64))
                have += held[-1].column(4).nbytes
                if have >= size:
                    yield flush()
                    number, have, held = number + 1, 0, []
        if held:
            yield flush()

    spark = rows.sparkSession
    schema = "chunk long, keys array<long>, nuls array<boolean>, a array<long>, b array<long>, sizes array<long>, z binary"
    chunks = rows.select("key", "nul", "a", "b", "text").mapInArrow(run, schema)
    return _bucketed(spark, chunks, "chunk", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))


def _bucketed(spark: SparkSession, df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` kept in the shared folder in buckets, so that joins on ``column`` do not move it."""
    name = f"strataframe_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", new_folder(spark, "chunks")).option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    out.schema  # the table is known to the plan from here on; only its name goes  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return out


def _copies(chunks: DataFrame) -> DataFrame:
    """``(chunk, pos, first)``: for each chunk the rows whose whole text a row of smaller key has, with the smallest such key."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "a", "b")).alias("pos", "x")).select("chunk", "pos", "x.keys", "x.a", "x.b")
    first = kept(each.groupBy(F.col("a").alias("fa"), F.col("b").alias("fb")).agg(F.min("keys").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    more = each.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where("first < keys")
    return kept(more.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("pos", "first")).alias("copies")), "copies")


class _Chunk:
    """The texts of a chunk that are no copies of a row of smaller key, as word hashes."""

    def __init__(self, row: dict, hashed: bool = True):
        self.number, self.keys, sizes = row["chunk"], np.array(row["keys"], np.int64), row["sizes"]
        raw, ends = zstandard.ZstdDecompressor().decompress(row["z"]), np.cumsum(sizes).tolist()
        self.texts = [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        self.first = {c["pos"]: c["first"] for c in row["copies"] or []}
        if hashed:
            self.own = np.array([i for i in range(len(self.texts)) if i not in self.first], np.int64)
            self.words, self.other, self.counts = word_hashes([self.texts[i] for i in self.own])
            self.start = np.cumsum(self.counts) - self.counts

    def windows(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, _Groups]:
        """Of all windows of ``n`` words: place and text, and the windows in groups of equal ones."""
        at, owner = _inside(self.counts, n)
        other = window_hashes(self.other, n)
        return at, owner, _Groups(window_hashes(self.words, n)[at], self.keys[self.own[owner]], lambda rows: (other[at[rows]] % np.uint64(buckets)).astype(np.int64))


class _Groups:
    """Rows in groups of equal hashes: the group ``of`` each row; of each group its hash, its smallest key, whether it has ``many`` keys, and its range."""

    def __init__(self, h: np.ndarray, key: np.ndarray, ranges: Callable[[np.ndarray], np.ndarray]):
        order = np.argsort(h)
        ordered = h[order]
        begin = np.flatnonzero(_new_runs(ordered))
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(h)]))
        self.h, own = ordered[begin], key[order]
        self.least = np.minimum.reduceat(own, begin) if len(begin) else own
        self.many = (np.maximum.reduceat(own, begin) if len(begin) else own) != self.least
        self.bucket = ranges(order[begin])

    def told(self, answers: list[dict] | None, flag: bool = False) -> np.ndarray:
        """For each group whether the answers have its hash; with ``flag``, whether its flag there is set."""
        known = [_unpack(a["z"]) for a in answers or [] if a["bucket"] >= 0]
        if not known or not len(self.h):
            return np.zeros(len(self.h), bool)
        h, flags = (np.concatenate(c) for c in zip(*known, strict=True))
        order = np.argsort(h)
        at = order[np.minimum(np.searchsorted(h[order], self.h), len(h) - 1)]
        return (h[at] == self.h) & (flags[at].astype(bool) if flag else True)

    def sent(self, chunk: int, which: np.ndarray, with_keys: bool = True) -> Iterator[tuple]:
        """A row for each range: its hashes among the groups ``which``, in order, with their smallest keys."""
        rows = np.flatnonzero(which)
        rows = rows[np.argsort(self.bucket[rows].astype(np.uint16) if self.bucket.max(initial=0) < 1 << 16 else self.bucket[rows], kind="stable")]
        bucket = self.bucket[rows]
        cuts = np.flatnonzero(_new_runs(bucket)) if len(rows) else rows
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=False):
            yield int(bucket[s]), chunk, _pack(self.h[rows[s:e]], *([self.least[rows[s:e]]] if with_keys else []))


def _shared(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal ``h``: whether they have different keys, and the smallest key."""
    g = _Groups(h, key, lambda rows: rows)
    return g.many[g.of], g.least[g.of]


_SENT = "bucket long, chunk long, z binary"


def _per_chunk(df: DataFrame, function: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """``function`` on every row of ``df``, a chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
        names, types = zip(*[(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")], strict=True)
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(function(batch.slice(i, 1).to_pylist()[0]))
                for at in range(0, len(out), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 2048], strict=True), types, strict=True)], names=list(names))

    return df.mapInArrow(run, schema)


def _answers(sent: DataFrame, name: str) -> DataFrame:
    """``(name_c, name)``: for each chunk the hashes of each range that another chunk sent too, with a flag: under a smaller key.

    Rows of a negative range are not compared and come back as they are.
    """

    def told(bucket: int, chunks: list[int], parts: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        h = np.concatenate([p[0] for p in parts])
        key = np.concatenate([p[1] if len(p) > 1 else np.full(len(p[0]), i, np.int64) for i, p in enumerate(parts)])
        many, least = _shared(key, h)
        ends = np.cumsum([len(p[0]) for p in parts]).tolist()
        for chunk, p, e in zip(chunks, parts, ends, strict=True):
            own = slice(e - len(p[0]), e)
            if many[own].any():
                yield chunk, bucket, _pack(h[own][many[own]], (key[own] > least[own])[many[own]].astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, parts = None, [], []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "bucket", "z"])

        for batch in batches:
            for bucket, chunk, z in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket < 0:
                    yield out([(chunk, bucket, z)])
                    continue
                if bucket != now:
                    if parts and (rows := list(told(now, chunks, parts))):
                        yield out(rows)
                    now, chunks, parts = bucket, [], []
                chunks.append(chunk)
                parts.append(_unpack(z))
        if parts and (rows := list(told(now, chunks, parts))):
            yield out(rows)

    place = F.when(F.col("bucket") < 0, F.xxhash64("chunk")).otherwise(F.col("bucket"))
    back = sent.repartition(place).sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket long, z binary")
    return kept(back.groupBy(F.col("chunk").alias(f"{name}_c")).agg(F.collect_list(F.struct("bucket", "z")).alias(name)), name)


def _with(chunks: DataFrame, answers: DataFrame, how: str = "left") -> DataFrame:
    key = answers.columns[0]
    return chunks.join(answers, F.col("chunk") == F.col(key), how).drop(key)


def _seeds(c: _Chunk, window: int, half: int, buckets: int) -> tuple[np.ndarray, _Groups]:
    """For each window the group of its seed. Of a seed 32 bits and its range are compared, for seeds are only candidates."""
    at, owner = _inside(c.counts, window)
    low = least_inside(c.words, window, half)[at]
    if not len(low):
        return at, _Groups(low, low.view(np.int64), lambda rows: rows)
    new = _new_runs(low, owner)  # neighbours mostly have one seed
    ranges = (low[new] >> np.uint64(32)) % np.uint64(buckets)
    g = _Groups(ranges << np.uint64(32) | low[new] & np.uint64(2**32 - 1), c.keys[c.own[owner[new]]], lambda rows: ranges[rows].astype(np.int64))
    return g.of[np.cumsum(new) - 1], g


def drop_repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, longest: bool = False) -> DataFrame:
    """``(key, n_words, n_removed, kept, starts, ends, longest)``: every row with its repeated passages taken out.

    A word goes when some window of ``window`` words covers it whose words also start in a row of smaller key. ``kept``
    joins the words left by one space; ``starts`` and ``ends`` are the removed spans in words. ``longest`` is the length
    of the last level, ``window`` times a power of two, at which a window of the text occurs in a different text; null if
    none does, for a copy of a row of smaller key, and throughout without ``longest``, where the doubling ends at
    ``window``. Windows are equal when a 64-bit hash of theirs and the range of another are: at 100 TB about one pair in
    all is taken for equal that is not.

    Null and empty texts have no words. Texts under ``window`` words lose nothing. Keys are integers; a null key counts as
    the largest one. A repeated row gives its result again; rows of one key with different texts are judged each by its
    text, and take nothing from each other. The result has the key under its name and no other column of ``docs``. An
    empty table gives an empty result. A text has to fit into the memory of a task.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(content))).first()[0] or 0
    size = int(min(256 << 20, max(CHUNK, CHUNK * (total / 30e9) ** 0.5)))
    buckets = max(1, -(-total // (10 * BUCKET)))  # a text has a window for about six bytes, and fewer are sent
    half = (window + 1) // 2
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LARGEST)).alias("key"), F.col(key).isNull().alias("nul"), F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"), content.alias("text"))
    chunks = chunked(rows, size)
    chunks = _with(chunks, _copies(chunks)).drop("a", "b")

    def seeds(row: dict) -> Iterator[tuple]:
        c = _Chunk(row)
        g = _seeds(c, window, half, buckets)[1]
        yield from g.sent(c.number, np.ones(len(g.h), bool), with_keys=False)

    def extended(row: dict) -> Iterator[tuple]:
        c = _Chunk(row)
        of, seed = _seeds(c, window, half, buckets)
        found = (seed.many | seed.told(row["seeds"]))[of]
        _, _, g = c.windows(window, buckets)
        which = np.zeros(len(g.h), bool)
        which[g.of[found]] = True
        yield from g.sent(c.number, which)

    answers = _answers(_per_chunk(_with(chunks, _answers(_per_chunk(chunks, seeds, _SENT), "seeds")), extended, _SENT), "level")
    ready = _with(chunks, answers)
    if longest:
        ready = _with(ready, _levels(chunks, answers, window, buckets))
    else:
        ready = ready.withColumn("lengths", F.lit(None).cast("array<struct<bucket:bigint,z:binary>>"))

    def removed(row: dict) -> Iterator[tuple]:
        c = _Chunk(row)
        at, owner, g = c.windows(window, buckets)
        gone = (g.least[g.of] < c.keys[c.own[owner]]) | g.told(row["level"], flag=True)[g.of]
        at, owner = at[gone] - c.start[owner[gone]], owner[gone]
        cuts = np.searchsorted(owner, np.arange(len(c.own) + 1)).tolist()
        place = {int(p): i for i, p in enumerate(c.own)}
        length: dict[int, int] = {}
        for x in row["lengths"] or []:
            for i in _unpack(x["z"])[0].tolist():
                length[i] = max(length.get(i, 0), -x["bucket"])
        for i, t in enumerate(c.texts):
            words = t.split()
            if i in place:
                s, e = _spans(at[cuts[place[i]] : cuts[place[i] + 1]], window)
            else:
                s, e = ([0], [len(words)]) if len(words) >= window else ([], [])
            left, last = [], 0
            for x, y in zip(s, e, strict=True):
                left += words[last:x]
                last = y
            left = left + words[last:] if last else words
            yield int(c.keys[i]), row["nuls"][i], len(words), len(words) - len(left), b" ".join(left).decode("utf-8"), s, e, length.get(i)

    done = _per_chunk(ready, removed, "key long, nul boolean, n_words long, n_removed long, kept string, starts array<long>, ends array<long>, longest int")
    return done.select(F.when(~F.col("nul"), F.col("key")).alias(key), "n_words", "n_removed", "kept", "starts", "ends", "longest")


def _spans(at: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Joined spans of covered words from ascending window places."""
    if not len(at):
        return [], []
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + window])
    return at[new].tolist(), (np.r_[at[new[1:] - 1], at[-1]] + window).tolist()


def _levels(chunks: DataFrame, answers: DataFrame, window: int, buckets: int) -> DataFrame:
    """``(lengths_c, lengths)``: for each chunk the texts in which a window of a level repeats, under minus the level's length.

    A window of twice the length is looked at only where both its halves repeat; the loop ends when nothing survives.
    """
    n, names, every = window, [], None
    while True:

        def doubled(row: dict, n: int = n) -> Iterator[tuple]:
            c = _Chunk(row)
            at, owner, g = c.windows(n, buckets)
            repeats = np.zeros(len(c.words) + n + 1, bool)
            repeats[at[(g.many | g.told(row["now"]))[g.of]]] = True
            some = np.unique(owner[repeats[at]])
            if not len(some):
                return
            yield -n, c.number, _pack(c.own[some])
            at, owner, g = c.windows(2 * n, buckets)
            which = np.zeros(len(g.h), bool)
            which[g.of[repeats[at] & repeats[at + n]]] = True
            yield from g.sent(c.number, which)
            local = np.unique(owner[(g.many & which)[g.of]])
            if len(local):  # the next level has something to look at, whatever the others answer
                yield -(2 * n), c.number, _pack(c.own[local])

        now = answers.select(F.col(answers.columns[0]).alias("now_c"), F.col(answers.columns[1]).alias("now"))
        answers = _answers(_per_chunk(_with(chunks, now), doubled, _SENT), "level")
        told = answers.select("level_c", F.explode("level").alias("x")).where("x.bucket < 0")
        every = told if every is None else every.unionByName(told)
        n *= 2
        if answers.where(F.exists("level", lambda x: (x["bucket"] >= 0) | (x["bucket"] == -n))).isEmpty():
            return every.groupBy(F.col("level_c").alias("lengths_c")).agg(F.collect_list("x").alias("lengths"))
