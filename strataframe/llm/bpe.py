"""Byte-level BPE by tree reduction: halves are encoded on their own and joined where they meet.

Encodings of neighbouring stretches are elements of a monoid. Joining two encodes a window around the seam again and widens
it until what lies outside is proved to be stable:

* Bytes: a sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is the encoding of the
  pair's bytes. (Merges go by rank, then from the left. The first merge across a boundary would also be the first one in the
  pair alone, for whatever is least among all candidates is least among the pair's.) So a window is wide enough once the two
  pairs at its rims are stable.
* Texts: a match of the pattern depends on nothing before its start and on at most ``reach`` characters after its end. So
  matches that end so far before the seam stay, and once a match of the window starts where one of the right half does, all
  that follow are the same.

Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import release_memory
from .tokens import vocabulary_path

#: Characters of a text, bytes of a match and ids of an encoding that are not halved any further.
TEXT_LEAF, MATCH_LEAF, IDS_LEAF = 4096, 256, 4096
#: A task works on slices of a batch of about so many bytes, one text at least.
SLICE = 1 << 21
#: Matches of the pattern that a worker remembers.
KEEP = 300_000


class Vocabulary:
    """Tokens and their ranks, read from a file of lines ``base64(token) rank``."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.stable = lru_cache(1 << 16)(self._stable)

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short stretch: the pair of least rank is merged, the leftmost first, until no pair has a rank."""
        if len(data) > 64:
            return self._merge_long(data)
        ranks, none = self.ranks, len(self.ranks) << 1
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs. An entry counts while its part still starts there and the pair still ends there."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts at a place; -1: none starts there
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if i and (rank := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (rank, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches, from theirs."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1  # tokens of either side inside the window
        while True:
            window = self.merge(self.decode(left[-i:]) + self.decode(right[:j]))
            fine_left = i == len(left) or self.stable(left[-i - 1], window[0])
            fine_right = j == len(right) or self.stable(window[-1], right[j])
            if fine_left and fine_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if fine_left else min(2 * i, len(left))
            j = j if fine_right else min(2 * j, len(right))

    def fold(self, data: bytes, leaf: int = MATCH_LEAF) -> list[int]:
        """The encoding of any bytes, by halves."""
        if len(data) <= leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.fold(data[:half], leaf), self.fold(data[half:], leaf))

    def encode_match(self, match: str, leaf: int = MATCH_LEAF) -> list[int]:
        """A match that is itself a token is that token, whatever merges would give."""
        data = match.encode()
        return [self.ranks[data]] if data in self.ranks else self.fold(data, leaf)

    def decode(self, ids: list[int], leaf: int = IDS_LEAF) -> bytes:
        """The bytes of ids; an id that is not of the vocabulary raises."""
        if len(ids) <= leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


class _Known(dict):
    """Matches already encoded, as little-endian 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> bytes:
        found = self[match] = np.array(self.vocabulary.encode_match(match), "<u4").tobytes()
        return found


class Encoder:
    """Encodes texts whose matches of ``pattern`` are encoded each on its own.

    ``reach``: no match depends on anything before its start or more than so many characters after its end, nor on more than
    ``reach`` characters from its start where it is shorter.
    """

    def __init__(self, vocabulary: str, pattern: str, reach: int = 3, leaf: int = TEXT_LEAF, keep: int = KEEP):
        import regex

        self.vocabulary = Vocabulary(vocabulary_path(vocabulary))
        self.matches = regex.compile(pattern).findall
        self.reach, self.leaf, self.keep = reach, max(leaf, 1), keep
        self.known = _Known(self.vocabulary)

    def _join(self, left: list[str], right: list[str]) -> list[str]:
        cut, open_chars = len(left), 0
        while cut and open_chars < self.reach:  # these may go on into the right half
            cut -= 1
            open_chars += len(left[cut])
        tail, taken = "".join(left[cut:]), 4
        while True:
            head = right[:taken]
            window = tail + "".join(head)
            found = self.matches(window)
            if taken >= len(right):
                return left[:cut] + found
            starts = {at: i for i, at in enumerate(accumulate(map(len, head), initial=len(tail)))}
            at = 0
            for i, match in enumerate(found):
                if at in starts:
                    return left[:cut] + found[:i] + right[starts[at] :]
                at += len(match)
                if at > len(window) - self.reach:
                    break
            taken *= 2

    def split(self, text: str) -> list[str]:
        """All matches of a text, by halves."""
        if len(text) <= self.leaf:
            return self.matches(text)
        half = len(text) // 2
        return self._join(self.split(text[:half]), self.split(text[half:]))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers; null is empty."""
        if len(self.known) > self.keep:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(text))) if text else b""


def _with(df: DataFrame, column: str, added: list[StructField], work) -> DataFrame:
    """``df`` with new columns that ``work`` makes of slices of one; columns of the new names are replaced."""
    rest = df.drop(*[f.name for f in added if f.name.lower() != column.lower()])
    place = next(i for i, c in enumerate(rest.columns) if c.lower() == column.lower())
    keep = [i for i, c in enumerate(rest.columns) if c.lower() not in {f.name.lower() for f in added}]
    names = [f"c{i}" for i in range(len(rest.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *work(part.column(place))], names=[*[names[i] for i in keep], *[f"n{i}" for i in range(len(added))]])
                at = stop
        release_memory()

    schema = StructType([*[StructField(names[i], rest.schema.fields[i].dataType) for i in keep], *[StructField(f"n{i}", f.dataType) for i, f in enumerate(added)]])
    return rest.toDF(*names).mapInArrow(run, schema).toDF(*[rest.columns[i] for i in keep], *[f.name for f in added])


_workers: dict[tuple, Encoder | Vocabulary] = {}


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", reach: int = 3) -> DataFrame:
    """``df`` with ``ids``, the ids of each whole text as little-endian 32-bit integers, and their number ``count``.

    ``vocabulary``: the path of a file of ranks, or a public one's name. Null and empty texts have no ids. Repeated rows are
    encoded alike; an empty table stays empty. Columns of the two new names are replaced, others are kept. A text is held by
    one task, as it is in its row; of very long ones nothing is left out, nor of very long matches.
    """

    def work(texts: pa.Array) -> list[pa.Array]:
        if (vocabulary, pattern, reach) not in _workers:
            _workers[vocabulary, pattern, reach] = Encoder(vocabulary, pattern, reach)
        encoder = _workers[vocabulary, pattern, reach]
        found = [encoder.encode(t.as_py()) for t in texts]
        return [pa.array(found, pa.binary()), pa.array([len(f) // 4 for f in found], pa.int64())]

    return _with(df, text, [StructField(ids, BinaryType()), StructField(count, LongType())], work)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``, the bytes of ``ids`` as :func:`encode` gives them; null ids have none, and null is empty.

    An id that the vocabulary has not, or ids whose bytes are not whole 32-bit integers, raise. Repeated rows are decoded
    alike; an empty table stays empty. A column of the new name is replaced, others are kept.
    """

    def work(column: pa.Array) -> list[pa.Array]:
        if vocabulary not in _workers:
            _workers[vocabulary] = Vocabulary(vocabulary_path(vocabulary))
        decoder = _workers[vocabulary]
        return [pa.array([decoder.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in column], pa.binary())]

    return _with(df, ids, [StructField(decoded, BinaryType())], work)
