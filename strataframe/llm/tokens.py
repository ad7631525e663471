"""Tokenizing whole texts inside tasks, with a bounded memory of words already seen.

Both tokenizers treat pieces of a text on their own when it is cut before single white-space characters, so a piece is encoded
once and looked up afterwards. Arrow cuts the texts of a batch and numbers their different pieces; Python sees each
different piece of a batch once. A text with a long run of white space, with a character that is white space to one side
alone, or with a special token's string is cut by a slower rule or given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_memory

_PIECE = re.compile(r"\s*\S+|\s+")
#: White space to Python alone, and what begins the strings of special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_WHOLE = r"[\x1c-\x1f]|<\|"
#: Runs of white space that single cuts would change, and the characters that mark pieces below.
_BLANK = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = rf"{_BLANK}{{3}}|{_BLANK}{{2}}$|[\x01-\x03]|{_WHOLE}"
#: What a key begins with: a line break, a text's beginning, a piece as it is. Any other key follows a blank.
_LINE, _FIRST, _PLAIN = "\x01", "\x02", "\x03"
#: Keys that are one word of Latin letters, with a stop or comma or none: the model takes their bytes as they are.
_WORD_KEY = re.compile("([\x01\x02]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def _byte_lengths(tokenizer) -> np.ndarray:
    """Bytes of text behind each id of a byte-level vocabulary: one character of the token's string is one byte."""
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = len(token.removesuffix("</w>"))
    return out


def vocabulary_path(name: str) -> str:
    """``name`` if it is a path, else the path of the public tokenizer of that name on the machine that asks."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives all ids and the number of ids of each text; ``vocabulary`` is the path of a tokenizers file, or a public one's name.

    ``blanks_matter``: white space has ids of its own. Where it has none, letter case has none either, and pieces are
    looked up with ASCII letters in lower case. At most about ``keep`` pieces are remembered.
    """

    def __init__(self, vocabulary: str, keep: int = 500_000, blanks_matter: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.bytes = _byte_lengths(self.tokenizer)
        self.dtype = np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32
        self.keep = keep
        self.blanks_matter = blanks_matter
        self._one = {mark: [x.id for x in self.tokenizer.model.tokenize(token)] for mark, token in ((".", "."), (",", ","), *[(_LINE, _BYTE[10])] * blanks_matter)}
        self._clear()

    def forget(self) -> None:
        """Forget all pieces, at the end of a task."""
        self._clear()
        release_memory()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, self.dtype)
        self.ends = np.zeros(1 << 20, np.int64)  # entry n has ids[ends[n]:ends[n + 1]]
        self.n = 0

    def _add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        used, k = int(self.ends[self.n]), len(keys)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.dtype)])
        if self.n + k + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), k), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + k + 1] = used + np.cumsum(lengths)
        self.number.update(zip(keys, range(self.n, self.n + k), strict=True))
        self.n += k

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries ``at``, and the number of ids of each."""
        first = self.ends[at]
        length = self.ends[at + 1] - first
        ends = np.cumsum(length)
        return self.ids[np.arange(int(length.sum())) + np.repeat(first - (ends - length), length)], length

    def _piece(self, key: str) -> str:
        if not self.blanks_matter:
            return key
        mark = key[:1]
        if mark == _LINE:
            return "\n" + key[1:]
        return key[1:] if mark in (_FIRST, _PLAIN) and mark else " " + key

    def _joins(self, piece: str) -> bool:
        """Whether a piece has the same ids between other such pieces, and as many bytes in them as in itself."""
        if self.blanks_matter:
            return piece[:1] in (" ", "\n") and not piece[-1].isspace()
        return piece.isascii() or unicodedata.is_normalized("NFC", piece)

    def _words(self, keys: list[str]) -> list[str]:
        """Encode the keys that are plain words, each different word once; the other keys."""
        tokenize, one, known = self.tokenizer.model.tokenize, self._one, {}
        rest, own, ids, lengths = [], [], [], []
        lead = {"": _BYTE[32] if self.blanks_matter else "", _LINE: "", _FIRST: ""}
        for key in keys:
            m = _WORD_KEY(key)
            if m is None:
                rest.append(key)
                continue
            mark, word, stop = m.groups()
            if not word.isascii():
                word = (word if self.blanks_matter else word.lower()).encode().decode("latin-1").translate(_BYTE)
            word = lead[mark] + word
            found = known.get(word)
            if found is None:
                found = known[word] = [x.id for x in tokenize(word)]
            if mark == _LINE:
                found = one[_LINE] + found
            if stop:
                found = found + one[stop]
            own.append(key)
            ids += found
            lengths.append(len(found))
        if own:
            self._add(own, np.array(ids, self.dtype), np.array(lengths, np.int64))
        return rest

    def _learn(self, keys: list[str]) -> None:
        keys = self._words(keys)
        if not keys:
            return
        pieces = list(map(self._piece, keys))
        side = [i for i, p in enumerate(pieces) if p and self._joins(p)] if len(pieces) > 1 else []
        groups = [side[i : i + 250] for i in range(0, len(side), 250)]
        joint = "" if self.blanks_matter else " "
        found = self.tokenizer.encode_batch_fast([joint.join([pieces[i] for i in g]) for g in groups], add_special_tokens=False)
        done = set()
        for g, one in zip(groups, found, strict=True):
            ids = np.array(one.ids, self.dtype)
            ends = np.cumsum(self.bytes[ids])
            want = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in map(pieces.__getitem__, g)])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                self._add([keys[i] for i in g], ids, np.diff(at, prepend=-1))
                done.update(g)
        alone = [i for i in range(len(keys)) if i not in done]
        if alone:
            each = [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
            self._add([keys[i] for i in alone], np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)))

    def _entries(self, keys: list[str]) -> np.ndarray:
        """The entries of different keys; new ones are encoded."""
        found = list(map(self.number.get, keys))
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            self._learn([keys[i] for i in new])
            for i in new:
                found[i] = self.number[keys[i]]
        return np.array(found, np.int64)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of every text as keys, and the number of pieces of each."""
        if self.blanks_matter:
            slow = pc.match_substring_regex(texts, _RUNS)
            marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", " " + _LINE), "")
            lists = pc.split_pattern(marked, " ")
        else:
            slow = pc.match_substring_regex(texts, _WHOLE)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        odd = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not len(odd):
            return flat, counts
        parts, last, starts = [], 0, np.r_[0, np.cumsum(counts)]
        for i in odd.tolist():
            t = texts[i].as_py()
            own = [t] if not self.blanks_matter or any(x in t for x in _ODD) else _PIECE.findall(t)
            own = [_PLAIN + p for p in own] if self.blanks_matter else own
            parts += [flat.slice(starts[last], starts[i] - starts[last]), pa.array(own, pa.string())]
            counts[i], last = len(own), i + 1
        return pa.concat_arrays([*parts, flat.slice(starts[last])]), counts

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.keep:
            self._clear()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        flat, counts = self._cut(pc.fill_null(texts, ""))
        numbered = flat.dictionary_encode()
        entries = self._entries(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, lengths = self._gather(entries[numbered.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64))
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]])


def encoded(texts: pa.Array, encoder: Encoder, end: int, chars: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of ``texts`` of about ``chars`` bytes (one text at least): its start, all ids with ``end`` after each text, and the number of ids of each text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right")))
        ids, n = encoder.encode(texts.slice(at, stop - at))
        yield at, np.insert(ids, np.cumsum(n), end), n + 1
        at = stop


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, blanks_matter: bool) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (vocabulary, blanks_matter) not in _encoders:
        _encoders[vocabulary, blanks_matter] = Encoder(vocabulary, blanks_matter=blanks_matter)
    return _encoders[vocabulary, blanks_matter]
