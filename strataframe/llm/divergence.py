"""How the words of the sources of a language differ: count-level bitmaps.

For every group (language, source) and every count there is a bitset of the terms that have that count there. The AND of two
groups' bitsets and its population count give how many terms have one count here and another there: the joint cells of a
pair, each worth the same divergence. Terms without an occurrence need no bitset, for complements give their cells. Bitsets are
cut into blocks of terms, each language's by a hash of the term, so a task holds the bitsets of one block; inside a block terms are numbered by falling
frequency, which brings like counts into the same words, and only words that are not zero are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, release_memory, text_or_empty

#: Probabilities are whole numbers of so many parts.
PARTS = 1_000_000_000
#: Terms are maximal runs of ASCII letters and of anything beyond ASCII; A-Z count as a-z.
_SPLIT = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A text is cut into terms in slices of about so many bytes; a task passes its counts on when it holds so many.
SLICE, HELD = 1 << 22, 300_000
#: Rows (group and term) that a block of bitmaps is made of, about; pairs of words that are compared at once.
BLOCK_ROWS, AT_ONCE = 100_000, 1 << 18
#: A term's number of occurrences and of documents in one integer.
_DOCUMENT = 1 << 48


def _terms(text: bytes) -> Iterator[list[bytes]]:
    plain, at = text.translate(_SPLIT), 0
    while at < len(plain):
        stop = len(plain) if len(plain) - at <= SLICE else plain.find(b" ", at + SLICE)
        stop = stop if stop >= 0 else len(plain)
        yield plain[at:stop].split()
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple, dict[bytes, int]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (language, source), own in groups.items():
            held = np.fromiter(own.values(), np.int64, len(own))
            columns = [pa.array([language] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(held % _DOCUMENT), pa.array(held // _DOCUMENT)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    total = 0
    for batch in batches:
        for language, source, text in zip(*[batch.column(i) for i in range(3)], strict=True):
            counts: Counter[bytes] = Counter()
            for some in _terms(text.as_py()):
                counts.update(some)
            own = groups.setdefault((language.as_py(), source.as_py()), {})
            total -= len(own)
            for term, n in counts.items():
                own[term] = own.get(term, 0) + n + _DOCUMENT
            total += len(own)
            if total > HELD:
                yield from passed_on()
                total = 0
    yield from passed_on()
    release_memory()


def _bitmaps(table: pa.Table) -> pa.Table:
    """The bitsets of one block, a row for each source and count: the words that are not zero, and their places."""
    source, term, n, total = (table.column(c) for c in ("source", "term", "n", "total"))
    coded = term.combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy()
    totals = np.zeros(len(coded.dictionary), np.int64)
    totals[code] = total.to_numpy()
    number = np.empty(len(totals), np.int64)
    number[np.lexsort((np.arange(len(totals)), -totals))] = np.arange(len(totals))
    sources = source.combine_chunks().dictionary_encode()
    s, count, bit = sources.indices.to_numpy(), n.to_numpy(), number[code]
    order = np.lexsort((bit, count, s))
    s, count, bit = s[order], count[order], bit[order]
    word = bit >> 6
    new_level = np.r_[True, (s[1:] != s[:-1]) | (count[1:] != count[:-1])]
    first = np.flatnonzero(new_level | np.r_[True, word[1:] != word[:-1]])
    words = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)), first)
    places = word[first].astype(np.int32)
    levels = np.flatnonzero(new_level)
    cuts = np.searchsorted(first, [*levels.tolist(), len(bit)])
    rows = len(levels)
    return pa.table({
        "lang": [table.column("lang")[0].as_py()] * rows, "block": pa.array([table.column("block")[0].as_py()] * rows, pa.int32()), "source": sources.dictionary.take(pa.array(s[levels])),
        "n": pa.array(count[levels]), "terms": pa.array(np.full(rows, len(totals), np.int64)),
        "places": pa.array([places[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "words": pa.array([words[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
    })


def _share(n: int, all_n: int, terms: int) -> int:
    """What a term of ``n`` occurrences has of ``PARTS``, two occurrences added to each of the kept terms."""
    return 1 + PARTS * (n + 2) // (all_n + 2 * terms)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Group:
    """The bitsets of one source in one block: words by place, each with its count's level; level 0 has no bitset."""

    def __init__(self, counts: list[int], places: list[bytes], words: list[bytes], all_n: int, terms: int, in_block: int):
        self.share = np.array([_share(n, all_n, terms) for n in (0, *counts)], np.int64)
        at = [np.frombuffer(p, np.int32) for p in places]
        place = np.concatenate([*at, np.zeros(0, np.int32)])
        order = np.argsort(place, kind="stable")
        self.place = place[order]
        self.word = np.concatenate([*[np.frombuffer(w, np.uint64) for w in words], np.zeros(0, np.uint64)])[order]
        self.level = np.repeat(np.arange(1, len(at) + 1), [len(a) for a in at])[order]
        self.size = np.bincount(self.level, weights=np.bitwise_count(self.word), minlength=len(self.share)).astype(np.int64)
        self.size[0] = in_block - self.size.sum()
        self.starts = np.searchsorted(self.place, np.arange((in_block + 63) // 64 + 1))


def _of_pair(x: _Group, y: _Group) -> int:
    """The divergence of two groups over the terms of a block."""
    value, in_x, in_y = 0, np.zeros(len(x.share), np.int64), np.zeros(len(y.share), np.int64)
    others = (y.starts[1:] - y.starts[:-1])[x.place]  # words of y at the place of each word of x
    ends = np.cumsum(others)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        here = others[at:stop]
        i = np.repeat(np.arange(at, stop), here)
        j = np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here) + y.starts[x.place[i]]
        both = np.bitwise_count(x.word[i] & y.word[j]).astype(np.int64)
        hit = np.flatnonzero(both)
        both, a, b = both[hit], x.level[i[hit]], y.level[j[hit]]
        value += int((both * _divergence(x.share[a], y.share[b])).sum())
        in_x += np.bincount(a, weights=both, minlength=len(in_x)).astype(np.int64)
        in_y += np.bincount(b, weights=both, minlength=len(in_y)).astype(np.int64)
        at = stop
    only_x, only_y = x.size[1:] - in_x[1:], y.size[1:] - in_y[1:]  # the other has none of these terms
    neither = int(y.size[0] - only_x.sum())
    value += int((only_x * _divergence(x.share[1:], y.share[:1])).sum()) + int((only_y * _divergence(y.share[1:], x.share[:1])).sum())
    return value + neither * int(_divergence(x.share[:1], y.share[:1])[0])


def _pairs(table: pa.Table) -> pa.Table:
    """The divergences of all pairs of a language's sources over one block."""
    rows = table.select(["source", "all_n", "kept_terms", "terms", "n", "places", "words"]).to_pylist()
    in_block = max((r["terms"] or 0 for r in rows), default=0)
    of: dict[str, list[dict]] = {}
    for r in rows:
        of.setdefault(r["source"], []).append(r)
    names, values = sorted(of), []
    if in_block:
        groups = []
        for name in names:
            levels = [r for r in of[name] if r["n"] is not None]
            groups.append(_Group([r["n"] for r in levels], [r["places"] for r in levels], [r["words"] for r in levels], of[name][0]["all_n"], of[name][0]["kept_terms"], in_block))
        values = [(i, j, _of_pair(groups[i], groups[j])) for i in range(len(names)) for j in range(i)]
    else:
        values = [(i, j, 0) for i in range(len(names)) for j in range(i)]
    values += [(j, i, v) for i, j, v in values]
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(values), pa.string()), "source": pa.array([names[i] for i, _, _ in values], pa.string()), "item": pa.array([names[j] for _, j, _ in values], pa.string()), "value": pa.array([v for _, _, v in values], pa.int64())})


def _share_of(n: str, all_n: str, terms: str) -> Column:
    """:func:`_share` as a column; decimals, because counts times ``PARTS`` outgrow a long."""
    top, below = f"cast({PARTS} as decimal(10,0)) * (cast({n} as decimal(19,0)) + 2)", f"cast({all_n} + 2 * {terms} as decimal(19,0))"
    return F.expr(f"1 + cast(({top} - ({top}) % {below}) / {below} as bigint)")


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10) -> DataFrame:
    """``(lang, source, term, n, total)``: occurrences of each term in each group and in its language, of terms in at least ``least`` documents of the language."""
    rows = docs.select(text_or_empty(lang).cast("string").alias("lang"), text_or_empty(source).cast("string").alias("source"), text_or_empty(text).cast("string").cast("binary").alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    summed = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    return summed.withColumns({"total": F.sum("n").over(own), "in_docs": F.sum("docs").over(own)}).where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from each other one, and what it says more often.

    Part ``pair``: all other sources of the language, ranked by falling divergence over all kept terms of the language. Part
    ``term``: the ``top`` terms that the source has oftener than the language, by falling divergence. Ties go by item. A
    term is kept if at least ``least`` documents of the language have it. Nulls are empty strings; repeated rows count as
    often as they occur; very long texts are counted to their end; groups without terms are groups like others; an empty
    table gives no rows. Other columns play no part. Everything is computed in whole numbers.
    """
    terms = kept(count_terms(docs, text, lang, source, least), "terms")
    groups = docs.select(text_or_empty(lang).cast("string").alias("lang"), text_or_empty(source).cast("string").alias("source")).distinct()
    counted = terms.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("all_n"))
    different = terms.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy(F.col("lang").alias("vl")).agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = groups.join(counted, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(different, F.col("lang") == F.col("vl"), "left")
    sizes = kept(sizes.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(a) for c, a in (("all_n", "all_n"), ("v", "kept_terms"), ("lang_n", "lang_n"))]), "groups")

    blocks = max(1, -(-terms.count() // BLOCK_ROWS))
    blocked = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    levels = kept(blocked.groupBy("lang", "block").applyInArrow(_bitmaps, "lang string, block int, source string, n long, terms long, places binary, words binary"), "levels")
    everywhere = sizes.select("lang", "source", "all_n", "kept_terms", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sets = levels.select(F.col("lang").alias("l"), F.col("block").alias("b"), F.col("source").alias("s"), "n", "terms", "places", "words")
    met = everywhere.join(sets, (F.col("lang") == F.col("l")) & (F.col("block") == F.col("b")) & (F.col("source") == F.col("s")), "left").drop("l", "b", "s")
    by_block = met.groupBy("lang", "block").applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = by_block.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    own = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), "all_n", "kept_terms", "lang_n")
    shares = terms.join(own, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).select("lang", "source", F.col("term").alias("item"), _share_of("n", "all_n", "kept_terms").alias("p"), _share_of("total", "lang_n", "kept_terms").alias("q"))
    said = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    said = said.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(said)
