"""Token ids as wavelet matrices, one succinct file for each shard.

Plane ``l`` holds bit ``levels - 1 - l`` of every id, the ids having been moved, stably and level by level, zeros before ones.
With the ranks at every ``STEP`` bits, a file answers: the id at a place, how often an id occurs before a place, and where
its k-th occurrence is, each in one step a plane, and unpacks only the blocks of the planes that these steps touch.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoded, encoder

#: Bits between ranks; bytes of a plane that are compressed together, a multiple of that.
STEP, BLOCK = 512, 1 << 13
_MAGIC = b"WVM2"


class Planes:
    """Bit planes as rows of bytes, all in memory or in compressed blocks that are unpacked when they are first read."""

    def __init__(self, width: int, whole: np.ndarray | None = None, blocks: list[list[bytes]] | None = None):
        self.width, self.whole, self.blocks, self.read = width, whole, blocks, {}

    def __len__(self) -> int:
        return len(self.whole if self.whole is not None else self.blocks)

    def _block(self, level: int, number: int) -> np.ndarray:
        if (level, number) not in self.read:
            self.read[level, number] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[level][number]), np.uint8)
        return self.read[level, number]

    def part(self, level: int, start: int, stop: int) -> np.ndarray:
        """Bytes of a plane; they lie in one block or two."""
        stop = min(stop, self.width)
        if start >= stop:
            return np.zeros(0, np.uint8)
        if self.whole is not None:
            return self.whole[level, start:stop]
        first, last = start // BLOCK, (stop - 1) // BLOCK
        parts = [self._block(level, i) for i in range(first, last + 1)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts))[start - first * BLOCK : stop - first * BLOCK]

    def plane(self, level: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[level]
        return np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, self.blocks[level])), np.uint8)


class WaveletMatrix:
    """Bit planes of a sequence of ids under ``2 ** levels``."""

    def __init__(self, planes: Planes, n: int, zeros: np.ndarray, ranks: np.ndarray):
        self.planes, self.n, self.zeros, self.levels, self.ranks = planes, n, zeros, len(planes), ranks

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = np.zeros((levels, -(-len(ids) // 8)), np.uint8), np.zeros(levels, np.int64)
        for level in range(levels):
            one = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
            planes[level] = np.packbits(one)
            low = now.take(np.flatnonzero(~one))
            zeros[level] = len(low)
            now = np.concatenate([low, now.take(np.flatnonzero(one))])
        wide = np.zeros((levels, -(-planes.shape[1] // (STEP // 8)) * (STEP // 8)), np.uint8)
        wide[:, : planes.shape[1]] = planes
        ones = np.bitwise_count(wide).reshape(levels, -1, STEP // 8).sum(2, dtype=np.uint32)
        ranks = np.concatenate([np.zeros((levels, 1), np.uint32), np.cumsum(ones, 1, dtype=np.uint32)], 1)
        return cls(Planes(planes.shape[1], planes), len(ids), zeros, ranks)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.planes.plane(level), count=self.n).view(bool)
            z, up = int(self.zeros[level]), np.empty_like(now)
            up[np.flatnonzero(~one)] = now[:z]
            up[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << (self.levels - 1 - level))
            now = up
        return now

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes.part(level, i >> 3, (i >> 3) + 1)[0]) >> (7 - (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // STEP
        bits = np.unpackbits(self.planes.part(level, block * STEP // 8, -(-i // 8)))[: i - block * STEP]
        return int(self.ranks[level, block]) + int(np.count_nonzero(bits))

    def select(self, level: int, bit: int, k: int) -> int:
        """The place of the ``k``-th (from 0) bit of a kind in a plane."""

        def before(block: int) -> int:
            ones = int(self.ranks[level, block])
            return ones if bit else min(block * STEP, self.n) - ones

        block = bisect_right(range(self.ranks.shape[1]), k, key=before) - 1
        bits = np.unpackbits(self.planes.part(level, block * STEP // 8, (block + 1) * STEP // 8))[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(bits == bit)[k - before(block)])

    def access(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            one = self._bit(level, i)
            r = self.rank1(level, i)
            i = int(self.zeros[level]) + r if one else i - r
            value = value << 1 | one
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.levels):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """How often an id occurs among the first ``end``."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, self.n if end is None else min(max(end, 0), self.n))
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of an id; -1 if there are fewer."""
        lo, hi = self._range(token, self.n) if not token >> self.levels else (0, 0)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            i = self.select(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def to_bytes(self) -> bytes:
        """Sizes, zeros and ranks in one compressed frame, then the blocks of all planes, each a frame of its own."""
        pack = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
        blocks = [pack(row[at : at + BLOCK].tobytes()) for row in map(self.planes.plane, range(self.levels)) for at in range(0, self.planes.width, BLOCK)]
        head = pack(self.zeros.astype("<i8").tobytes() + np.array(list(map(len, blocks)), "<u4").tobytes() + self.ranks.astype("<u4").tobytes())
        return struct.pack("<IQQ", self.levels, self.n, len(head)) + head + b"".join(blocks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        levels, n, size = struct.unpack_from("<IQQ", data)
        raw, width = zstandard.ZstdDecompressor().decompress(data[20 : 20 + size]), -(-n // 8)
        per = -(-width // BLOCK)
        zeros = np.frombuffer(raw, "<i8", levels)
        lengths = np.frombuffer(raw, "<u4", levels * per, 8 * levels)
        ranks = np.frombuffer(raw, "<u4", offset=8 * levels + 4 * levels * per).reshape(levels, -1)
        ends = (20 + size + np.cumsum(lengths, dtype=np.int64)).tolist()
        view = memoryview(data)
        blocks = [view[e - x : e] for e, x in zip(ends, lengths.tolist(), strict=True)]
        return cls(Planes(width, blocks=[blocks[i * per : (i + 1) * per] for i in range(levels)]), n, zeros, ranks)


def pack_file(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    """A file: magic, one zstandard frame of the documents' keys and counts, and the matrix of all their ids in blocks."""
    known = np.array([k is not None for k in keys], bool)
    head = struct.pack("<Q", len(keys)) + np.array([k or 0 for k in keys], "<i8").tobytes() + np.packbits(known).tobytes() + counts.astype("<i8").tobytes()
    head = zstandard.ZstdCompressor(level=1, write_checksum=True).compress(head)
    return _MAGIC + struct.pack("<Q", len(head)) + head + WaveletMatrix.of(ids, levels).to_bytes()


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The keys, counts and matrix of a file; of the matrix only the blocks that are asked for are unpacked."""
    if data[:4] != _MAGIC:
        raise ValueError("not a wavelet file")
    (size,) = struct.unpack_from("<Q", data, 4)
    raw = zstandard.ZstdDecompressor().decompress(data[12 : 12 + size])
    (n,) = struct.unpack_from("<Q", raw)
    keys = np.frombuffer(raw, "<i8", n, 8)
    known = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), 8 + 8 * n), count=n).astype(bool)
    counts = np.frombuffer(raw, "<i8", n, 8 + 8 * n + -(-n // 8))
    return [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], counts, WaveletMatrix.from_bytes(data[12 + size :])


def write_tokens(df: DataFrame, vocabulary: str, path: str, end: int, key: str = "doc_id", text: str = "text", tokens_per_file: int = 1 << 18, blanks_matter: bool = False, levels: int | None = None) -> None:
    """Encode every text, end it with ``end``, and write files of about ``tokens_per_file`` ids under ``path``.

    ``path`` is a Parquet table of the files, in ascending order of ``key``: ``part`` and ``number`` order them, ``content``
    is the file. Spark writes it, so that any store will do and a task that is repeated leaves one copy. Null keys come
    first; a null text counts as empty and has ``end`` alone; a text longer than a file has a file of its own. There are as
    many planes as the vocabulary's ids have bits, unless ``levels`` says so.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        e = encoder(vocabulary, blanks_matter)
        planes = levels or max(end, len(e.bytes) - 1).bit_length()
        keys, counts, ids, have = [], [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(ids)
            content = pack_file(keys, np.concatenate(counts), every, planes)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(every)], pa.int64()), pa.array([content], pa.binary())], names=["part", "number", "n_docs", "n_tokens", "content"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for at, more, n in encoded(batch.column(1), e, end):
                keys += own[at : at + len(n)]
                counts.append(n)
                ids.append(more)
                have += len(more)
                if have >= tokens_per_file:
                    yield flush()
                    number += 1
                    keys, counts, ids, have = [], [], [], 0
        if keys:
            yield flush()
        e.forget()

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    rows.mapInArrow(files, "part int, number int, n_docs long, n_tokens long, content binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32, file, place)`` of every document in the files, with ``ids`` if asked for.

    ``start`` counts the ids of all documents before it; ``file`` and ``place`` tell where its first id is.
    """
    files = spark.read.parquet(path)
    sizes = files.select("part", "number", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("bp"), F.col("number").alias("bn"), (F.col("base") + F.col("inner")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, matrix = open_file(batch.column(2)[i].as_py())
                ids = matrix.decode()
                stop = np.cumsum(counts)
                wide = memoryview(np.ascontiguousarray(ids.astype("<u4")))
                n = len(keys)
                crc = [zlib.crc32(wide[e - c : e]) for e, c in zip(stop.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[i].as_py(), np.int32)), pa.array(stop - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, stop].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["key", "part", "number", "place", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    docs = files.select("part", "number", "content").mapInArrow(documents, "key long, part int, number int, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    out = docs.join(bases, (F.col("part") == F.col("bp")) & (F.col("number") == F.col("bn")))
    return out.select(F.col("key").alias(key), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", F.struct("part", "number").alias("file"), "place", *["ids"] * with_ids)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``(part, number, n, first)``: how often an id occurs in each file, and its first place there (-1: nowhere)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [open_file(x.as_py())[2] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.count(token) for m in found], pa.int64()), pa.array([m.locate(token, 0) for m in found], pa.int64())], names=["part", "number", "n", "first"])

    return spark.read.parquet(path).select("part", "number", "content").mapInArrow(look, "part int, number int, n long, first long")
