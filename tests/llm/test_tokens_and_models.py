import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataframe.llm import decontaminate, language, packing, queries, sharding, toxicity, wavelet
from strataframe.llm.common import new_folder
from strataframe.llm.tokens import Encoder, vocabulary_path

SF = "/root/testdata/sf0.01"
ODD = ["a  b\n\n c\t\td ", " lead", "x  y", "it's 'll <|endoftext|> ok", "", None, "\n", "é É éx", "ΑΣ ΑΣ.", "12 34,567\r\n  x", "日本語 テスト", "a\x0bb\x1cc  d", "😀 😀a", "CAFÉ, Straße. İx, don.t ., .. a.b, x).", "A, b. C.,"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_tokenizer(name, blanks):
    tokenizer, own = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), keep=30, blanks_matter=blanks)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t .,'AaÉéßж1٣漢😀-_") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for part in (texts[:50], texts[50:], texts):
        ids, n = own.encode(part)
        ends = np.cumsum(n)
        for t, e, k in zip(part, ends, n, strict=True):
            assert ids[e - k : e].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=1500), st.integers(0, 49407))
def test_wavelet_matrix(ids, token):
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(np.array(ids, np.uint16), 16).to_bytes())
    assert m.decode().tolist() == ids
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i] and m.count(ids[i], i) == ids[:i].count(ids[i])
    for t in {token, *ids[:3]}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert m.count(t) == len(places) and [m.locate(t, k) for k in range(len(places) + 1)] == [*places, -1]
    with pytest.raises(IndexError):
        m.access(len(ids))


def test_few_blocks_are_unpacked():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 49408, 400_000).astype(np.uint16)
    keys, counts, m = wavelet.open_file(wavelet.pack_file([1, None], np.array([399_999, 1]), ids, 16))
    assert keys == [1, None] and counts.tolist() == [399_999, 1]
    assert [m.access(i) for i in (0, 123_456, 399_999)] == [int(ids[i]) for i in (0, 123_456, 399_999)]
    assert len(m.planes.read) <= 3 * 2 * 16 < 16 * len(m.planes.blocks[0])
    token = int(ids[200_000])
    assert m.count(token) == int((ids == token).sum()) and m.locate(token, 0) == int(np.flatnonzero(ids == token)[0])
    assert (m.decode() == ids).all()


def test_token_files(spark, odd, odd_rows, none):
    path, vocabulary = new_folder(spark, "t"), queries.vocabulary("word_bpe_49k.json")
    wavelet.write_tokens(odd, vocabulary, path, 2, tokens_per_file=500)
    got = wavelet.read_tokens(spark, path, with_ids=True).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    tokenizer, start, want = Tokenizer.from_file(vocabulary_path(vocabulary)), 0, []
    for k, t in sorted(odd_rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), crc(ids), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got] == want
    counts = Counter(i for w in want for i in w[4])
    token = counts.most_common(3)[2][0]
    assert wavelet.occurrences(spark, path, token).agg(F.sum("n")).first()[0] == counts[token]
    empty = new_folder(spark, "t")
    wavelet.write_tokens(none, vocabulary, empty, 2)
    assert wavelet.read_tokens(spark, empty).count() == 0


def test_packing(spark, odd, odd_rows, none):
    vocabulary, capacity = queries.vocabulary("byte_bpe_50k.json"), 64
    got = packing.pack(odd, vocabulary, 2, capacity, with_ids=True).collect()
    tokenizer, want, total = Tokenizer.from_file(vocabulary_path(vocabulary)), Counter(), 0
    for k, t in odd_rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[k, i, a, b - a, crc(ids[a:b]), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.1 * -(-total // capacity) + 2
    assert packing.pack(none, vocabulary, 2).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=33, max_size=33))
def test_plan_packs_just_the_histogram(counts):
    h = np.array([0, *counts[1:]])
    planned, packed = packing.plan(h, 32), np.zeros(33, int)
    for lengths, times in planned:
        assert sum(lengths) <= 32 and times > 0
        for v in lengths:
            packed[v] += times
    assert (packed == h).all()
    bound = -(-int(h @ np.arange(33)) // 32)
    assert sum(t for _, t in planned) <= 11 / 9 * max(bound, int(h[17:].sum())) + 4


def test_language(spark, none):
    docs = queries.table(spark, SF, "documents")
    out = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.93 and all(0 <= r.score <= 1 for r in out)
    net = language.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the and of " * 5000, "x"), (4, "ü", "x")], "doc_id int, text string, lang_pred string")
    got = language.identify(odd, net)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}
    assert language.identify(none, net).count() == 0


def test_samples_are_bounded(spark, odd, none):
    rows = [(None, f"text number {i}", "en", i % 2) for i in range(10_000)] + [(3, "the same text", "en", 1)] * 10_000 + [(i, f"ein Text {i}", "de", i % 2) for i in range(4, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").withColumns({"label": F.lit(1), "k": F.lit(2), "h": F.lit(3), "n": F.lit(4)})
    got = language.sample(df, per_label=100, per_text=2).collect()
    rows_of = {x: len({r.h for r in got if r.label == x}) for x in ("en", "de")}
    assert rows_of["en"] == 100 and rows_of["de"] == 100 and len(got) <= 400  # equal rows count once
    labels = df.select("doc_id", "toxic", "label", "text")
    got = toxicity.sample(df, labels, per_class=100).collect()
    assert Counter(r.label for r in got) == {0: 100, 1: 100} and all(r.text.startswith("ein") or r.text == "the same text" for r in got)
    assert sum(len(r.text) for r in toxicity.sample(df, labels, per_class=100, chars=500).collect()) <= 500
    assert toxicity.sample(none, labels).count() == 0 == language.sample(none).count()
    net = toxicity.fit(odd, odd.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic", "key AS label", "text"))
    scored = toxicity.score(odd.unionByName(odd), net, spans="spans")
    assert scored.columns == [*[c for c in odd.columns if c != "score"], "score", "spans"] and scored.count() == 2 * odd.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_pair_tables_are_the_network():
    rng = np.random.default_rng(0)
    net = language.train(["abcab" * 60, "xyzzy" * 60] * 10, ["a", "b"] * 10, epochs=2)
    data = rng.integers(0, 256, 600, dtype=np.uint8).tobytes()
    w = language.windows(data)
    e, pooled = net.embedding[w], []
    for (width, _), k in zip(language.FILTERS, net.kernels, strict=True):
        r = np.stack([e[:, i : i + width].reshape(len(w), -1) @ k for i in range(language.WINDOW)], 1)
        pooled.append(r.max(1))
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.weights + net.offset
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(language.Scorer(net)._logits(w), want, atol=1e-3)
    assert len(w) == 3 and bytes(w[:, :256].ravel()[:600]) == data


def test_toxicity(spark, none):
    sf = "/root/testdata/sf0.1"  # the smaller tables have a few dozen toxic labels
    out = queries.op8_toxicity(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in out)
    good = [r.score for r in out if not r.toxic and r.held_out]
    bad = [r.score for r in out if r.toxic and r.held_out]
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    rng = random.Random(1)
    line = lambda: " ".join(f"v{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(8))
    texts = [". ".join([line(), line(), line() + (" grobian" if i % 4 == 0 else "")]) for i in range(400)]
    net = toxicity.train(texts, [int(i % 4 == 0) for i in range(400)])
    df = spark.createDataFrame([(1, f"{line()}. {line()} Grobian! {line()}"), (2, line()), (3, None), (4, ""), (5, ".\n.!")], "doc_id int, text string")
    got = {r.doc_id: (r.score > 0.5, [s.sentence for s in r.spans]) for r in toxicity.score(df, net, spans="spans").collect()}
    assert got == {1: (True, [1]), 2: (False, []), 3: (False, []), 4: (False, []), 5: (False, [])}
    assert toxicity.score(none, net).count() == 0
    assert toxicity.train([], []).bias == toxicity.PRIOR


def brute_leaks(docs, items, window=13, share=0.75, masks=decontaminate.MASKS):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in items:
        b = tokens(t)
        for k, u in docs:
            w = tokens(u)
            for m in masks:
                on = [j for j, c in enumerate(m) if c == "1"]
                seeds = {}
                for q in range(len(b) - len(m) + 1):
                    seeds.setdefault(tuple(b[q + j] for j in on), []).append(q)
                for p in range(len(w) - len(m) + 1):
                    for q in seeds.get(tuple(w[p + j] for j in on), ()):
                        first, n = max(0, q - p), 0
                        equal = [int(w[p - q + x] == b[x]) for x in range(first, min(len(b), len(w) - p + q))]
                        span = min(window, len(b))
                        n = max(sum(equal[max(0, x - span + 1) : x + 1]) for x in range(len(equal)))
                        if n >= -(-share * span // 1):
                            out.add((k, i))
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination(spark, odd, odd_rows, none, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
    rng = random.Random(9)
    source = odd_rows[20:34] + odd_rows[44:47]
    items = []
    for i, (_, t) in enumerate(source):
        w = (t or "").split()[:40]
        for j in range(rng.randrange(5), len(w), rng.choice([3, 5, 7])):
            w[j] = f"sub{j}"
        items.append((i, " ".join(w)))
    items += [(90, None), (91, ""), (92, "one two"), items[0]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).withColumn("seed", F.lit(2))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()}
    assert got == brute_leaks(odd_rows, items) and got
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted((k for k, _ in odd_rows if k not in {k for k, _ in got}), key=repr)
    passage = items[0][1]
    keyless = spark.createDataFrame([(None, "a " + passage), (None, "clean"), (1, passage), (1, "clean"), (2, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in decontaminate.decontaminate(keyless, bench).collect()), key=repr) == sorted([(None, "clean"), (1, "clean"), (2, None)], key=repr)
    assert decontaminate.contaminated(none, bench).count() == 0 == decontaminate.contaminated(odd, bench.limit(0)).count()


def test_sharding(spark, odd, odd_rows, none):
    tree = sharding.uniform_tree(40)
    big = spark.range(40_000).withColumnRenamed("id", "doc_id")
    out = sharding.shard(big, "doc_id", tree).collect()
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(40)) and 800 < min(sizes.values()) and max(sizes.values()) < 1200
    assert all(r.grown_shard in (r.shard, 40) for r in out) and 700 < sum(r.grown_shard == 40 for r in out) < 1250
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    heavy = [[list(k) for k in r] for r in tree]
    heavy[2][1][3] = 4.0
    moved = sharding.with_shard(sharding.with_shard(big, "doc_id", tree, "a"), "doc_id", heavy, "b").where("a <> b")
    assert moved.where("a DIV 8 <> 2 AND b DIV 8 <> 2").count() == 0 and moved.where("b = 23").count() > 1500
    got = sharding.shard(odd, "doc_id", tree)
    assert got.count() == len(odd_rows) and set(got.columns) == {*odd.columns, "grown_shard"}
    assert sharding.shard(none).count() == 0 and sharding.leaves(sharding.grow(tree)) == 41
    with pytest.raises(ValueError):
        sharding.uniform_tree(0)


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    columns, before = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert before is None or ids <= before
            before = ids
            docs = out
    assert {r.doc_id for r in out.select("doc_id").collect()} == before and 100 < len(before) < 200
    leaks = {k for k, _ in brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()])}
    assert not leaks & before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_pipeline_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(5000)]
    rows, want = [], set()
    for g in range(30):
        w = [rng.choice(words) for _ in range(200)]
        want.add(10 * g)
        rows.append((10 * g, " ".join(w)))
        for c in range(1, 4):
            v = list(w)
            for _ in range(c - 1):
                v[rng.randrange(200)] = "changed"
            rows.append((10 * g + c, " ".join(v)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows] + [(None, rows[0][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert {r.doc_id for r in out.where("doc_id IS NOT NULL").collect()} == want and out.where("doc_id IS NULL").count() == 0  # a copy of document 0
