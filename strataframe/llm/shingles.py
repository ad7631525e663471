"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: str | bytes | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the word shingles of ``text`` in lower case (A-Z only), repeats included."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(flat, 42)]
    return [h(flat[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]


def shingle_set(text: str | bytes | None, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted; none if it has no words."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))
