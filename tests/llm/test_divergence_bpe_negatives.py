"""Source divergence, tree-reduced BPE and hard negatives against restatements."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strataframe.llm import bpe, divergence, negatives, queries

SF = "/root/testdata/sf0.001"
NAME = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(NAME), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


PARTS = ["a", "b", "  ", " ", "\n", "'", "'re", "'s", "é", "ñ", "1", "22", "!", "?", "...", "日本", "中", "😀", " ", "\t", "x" * 30, "the", "ing", "'ll", "\x1c", "=-", "<|endoftext|>"]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 50, 4096])
def test_joined_texts_have_the_library_s_ids(library, leaf):
    rng, encoder = random.Random(leaf), bpe.Encoder(NAME, public_tokenizers.PATTERN, leaf=leaf)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        got = ids_of(encoder.encode(text))
        assert got == library.encode_ordinary(text), text
        assert encoder.vocabulary.decode(got, 3) == text.encode()


def test_joined_bytes_are_merged_bytes():
    rng, vocabulary = random.Random(3), bpe.Vocabulary(public_tokenizers.path(NAME))
    for _ in range(400):
        data = bytes(rng.choice(b"abcdeth in\xc3\xa9\xe6\x97") for _ in range(rng.randint(1, 200)))
        want = vocabulary.merge(data)
        assert vocabulary._merge_long(data) == want and all(vocabulary.fold(data, leaf) == want for leaf in (1, 2, 5, 64))
    for n in (1, 7, 100, 1023, 3000):
        assert vocabulary.fold(b"a" * n, 16) == vocabulary.merge(b"a" * n)


def test_long_matches(library):
    encoder = bpe.Encoder(NAME, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for text in ("a" * 20_000, "ab" * 20_000, " " * 9_000 + "z", "日" * 9_000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "1" * 9_001):
        assert ids_of(encoder.encode(text)) == library.encode_ordinary(text)


def test_encode_and_decode_odd_rows(spark, library, odd, none):
    out = bpe.decode(bpe.encode(odd.withColumnRenamed("words", "Ids"), NAME, public_tokenizers.PATTERN), NAME)
    assert sorted(out.columns) == sorted([*[c for c in odd.columns if c != "words"], "ids", "n_tokens", "decoded"])  # a column of a new name is replaced
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd.collect())
    assert Counter((r.doc_id, tuple(ids_of(bytes(r.ids))), bytes(r.decoded)) for r in out.collect()) == want
    assert bpe.decode(bpe.encode(none, NAME, public_tokenizers.PATTERN), NAME).count() == 0
    with pytest.raises(KeyError):
        bpe.Vocabulary(public_tokenizers.path(NAME)).decode([60_000])


def test_bpe_query(spark, library):
    want = set()
    for r in queries.table(spark, SF, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op12_tree_bpe(spark, SF).collect()} == want


def audited(rows, least=10, top=10):
    """The audit restated over ``(lang, source, text)``."""
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for lang, source, text in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, _, words in docs:
        seen[lang].update(set(words))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    groups = {(lang, source) for lang, source, _ in docs}
    for lang, source, words in docs:
        counts[lang, source].update(w for w in words if w in kept.get(lang, ()))

    def share(c, lang):
        n, v = sum(c.values()), len(kept[lang]) if lang in kept else 0
        return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept.get(lang, ())}

    out = set()
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang, source in groups:
        p = share(counts[lang, source], lang)
        others = [(-sum(f(p[t], q[t]) for t in p), s) for other, s in groups if other == lang and s != source for q in [share(counts[lang, s], lang)]]
        out |= {(lang, source, "pair", s, -v, i) for i, (v, s) in enumerate(sorted(others, key=lambda x: (x[0], x[1].encode())), 1)}
        whole = share(sum((counts[g] for g in groups if g[0] == lang), Counter()), lang)
        terms = [(-f(p[t], whole[t]), t) for t in p if counts[lang, source][t] and p[t] > whole[t]]
        out |= {(lang, source, "term", t, -v, i) for i, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top], 1)}
    return out


@pytest.mark.parametrize("block", [100_000, 40])
def test_divergence_of_odd_groups(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)  # many blocks, some without terms of a language
    rng = random.Random(8)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["ÄPFEL", "Äpfel", "straße", "日本", "x" * 300, "a-b", "B", "b"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "S1", "ß", None]), " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60)))) for _ in range(160)]
    rows += [rows[0]] * 12 + [("en", "bare", None), ("en", "numbers", "1 2 3"), ("fr", "a", "few words"), ("fr", "b", None), ("en", "s1", "long " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(7)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(audited(rows))


def test_divergence_of_nothing(spark, none):
    assert divergence.audit(none).count() == 0


def test_counts_survive_flushing_and_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "SLICE", 10)
    text = b"one two three One; four five six seven eight nine, ten-one \xc3\xa9t\xc3\xa9"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["a", "b"]), pa.array([text, b"two"])], names=["lang", "source", "text"])
    total = Counter()
    for out in divergence._count(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["source"], r["term"], "n"] += r["n"]
            total[r["source"], r["term"], "docs"] += r["docs"]
    assert total["a", "one", "n"] == 6 and total["a", "one", "docs"] == 2 and total["a", "été", "n"] == 2 and total["b", "two", "docs"] == 2


def mined(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    out = set()
    fine = [(k, y, v) for k, y, v in rows if k is not None and y is not None and v is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for k, y, v in fine:
        if is_anchor(k):
            scored = sorted(((-dot(v, w), o, z) for o, z, w in fine if o != k), key=lambda r: r[:2])
            for s, p, _ in [r for r in scored if r[2] == y][:positives]:
                window = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives_]
                out |= {(k, p, i, o, -s, -t) for i, (t, o, _) in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("codes,probe,block,top", [(None, 2048, 4096, 100), (6, 1, 16, 100), (30, 40, 7, 3), (4, 10, 50, 1 << 26)])
def test_negatives_of_odd_rows(spark, monkeypatch, codes, probe, block, top):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.integers(-top, top + 1, (220, 9)).tolist()
    rows = [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(base)]
    rows += [(300 + i, i % 3, base[0]) for i in range(60)] + [rows[20], rows[0], (500, 1, [5]), (501, 1, []), (502, None, base[1]), (None, 1, base[1]), (503, 1, None), (504, 2, [None] * 9), (505, 2, [0] * 9), (510, 2, base[3] + [7])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, label int, vector array<long>, query int, windows string").repartition(5)
    out = negatives.mine(df, F.col("id") % 10 == 0, codes=codes, probe=probe)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in out.collect()} == mined(rows, lambda k: k % 10 == 0)


def test_negatives_of_few_rows(spark):
    schema = "id long, label int, vector array<long>"
    mine = lambda rows: negatives.mine(spark.createDataFrame(rows, schema), F.col("id") % 10 == 0).collect()
    assert mine([]) == [] and mine([(1, 1, [1, 2])]) == [] and mine([(10, 1, [1, 2])]) == [] and mine([(10, 1, None)]) == []
    assert [tuple(r) for r in mine([(10, 1, [10, 0]), (1, 1, [10, 0]), (2, 2, [6, 0]), (3, 2, [99, 0])])] == [(10, 1, 1, 2, 100, 60)]


def test_cells_are_walked_by_falling_bound():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=12), rng.normal(size=9)
    walked = list(negatives.walk(a, b))
    assert len({(i, j) for i, j, _ in walked}) == 108 and all(x[2] >= y[2] for x, y in zip(walked, walked[1:], strict=False))
    assert all(np.isclose(a[i] + b[j], s) for i, j, s in walked)
