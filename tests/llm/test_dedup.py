import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataframe.llm import embeddings, lines, queries, simhash, substrings
from strataframe.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 5000 + i) for i in range(1, 90)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(df.limit(0)).count() == 0


def brute_passages(docs, window):
    docs = sorted(docs, key=lambda r: 2**63 if r[0] is None else r[0])
    words = [(k, WORD.findall(t or "")) for k, t in docs]
    first = {}
    for k, w in words:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            f = first[tuple(w[i : i + window])]
            if f is not None and (k is None or f < k):
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_passages(odd, odd_rows, window):
    got = substrings.drop_repeated_passages(odd, window=window).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_passages(odd_rows, window)


@pytest.mark.parametrize("chunk,bucket", [(1 << 20, 10**6), (200, 50), (1, 1)])
def test_passages_of_many_lengths(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    rng = random.Random(4)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = substrings.drop_repeated_passages(df, window=7, longest=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_passages(docs, 7)
    texts = dict(docs)
    for r in got:
        w, best, n = WORD.findall(texts[r.doc_id]), None, 7
        while n <= len(w):
            have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            others = (WORD.findall(t) for t in texts.values() if t != texts[r.doc_id])
            if any(have & {tuple(o[i : i + n]) for i in range(len(o) - n + 1)} for o in others):
                best, n = n, 2 * n
            else:
                break
        copy = any(t == texts[r.doc_id] and k < r.doc_id for k, t in docs)
        assert r.longest == (None if copy else best), r
    short = substrings.drop_repeated_passages(df, window=7)
    assert sorted(((r.doc_id, r.kept, r.longest) for r in short.collect()), key=repr) == sorted(((r.doc_id, r.kept, None) for r in got), key=repr)


def test_passages_of_extreme_keys(spark):
    own = " ".join(f"w{i}" for i in range(20))
    rows = [(-(2**63), own), (2**63 - 1, own), (None, own + " tail"), (5, "x " + own), (5, "x " + own), (5, "y " + own)]
    got = substrings.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=repr) == sorted([(-(2**63), own), (2**63 - 1, ""), (None, "tail"), (5, "x"), (5, "x"), (5, "y")], key=repr)


def test_no_passages(none):
    assert substrings.drop_repeated_passages(none).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d y")], "doc_id long, text string")
    r = substrings.drop_repeated_passages(df, window=3).where("doc_id = 2").first()
    assert (r.starts, r.ends, r.kept) == ([1], [5], "x y")


def brute_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_groups(odd, odd_rows, spark):
    got = simhash.near_duplicates(odd, shingle=4, radius=4).collect()
    prints = {i: brute_fingerprint(t, 4) for i, t in odd_rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = components(prints, links)
    assert sorted((r.key, r.f0 % 2**64, r.component) for r in got if r.key is not None) == sorted((i, prints[i], want[i]) for i, _ in odd_rows if i is not None)
    assert [r.component for r in got if r.key is None] == [None]
    native = spark.createDataFrame([("a b",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_links_connect_what_is_near(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    far = [rng.getrandbits(64) for _ in range(150)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for f in far for _ in range(3)]
    hot = [far[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)]
    prints = list(dict.fromkeys([*far, *near, *hot]))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(prints)], "node long, f0 long")
    got = [(r.a, r.b) for r in simhash.links(df, 1, 4).collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in got)
    want = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    assert components(range(len(prints)), got) == components(range(len(prints)), want)


def test_plan_covers_the_radius():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    bits[:, 10] = bits[:, 40]
    both = bits.T @ bits
    for n, radius in ((500, 4), (10**7, 4), (10**9, 4), (10**6, 11), (500, 0)):
        chosen = simhash.plan(n, both, radius)
        assert sum(t + 1 for _, t in chosen) > radius
        assert len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)


def brute_links(vectors, bound):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    return ok, [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= bound]


@pytest.mark.parametrize("block", [16, 1024])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 20] + rng.normal(scale=0.12, size=16)).tolist()) for i in range(200)]
    rows += [(2000 + i, base[7].tolist()) for i in range(30)] + [(3000, (base[7] * 5).tolist())]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [1.0] * 15 + [None]), (4005, [1.0] * 15 + [float("inf")]), (4006, [1.0, 2.0]), (4007, [1.0, 2.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("node", F.lit(2))
    got = {r.key: (r.n_links, r.component, r.kept) for r in embeddings.near_duplicates(df).collect()}
    ok, links = brute_links([r for r in rows if r[1] and len(r[1]) == 16], 0.95)
    links.append((4006, 4007))
    count, parts = defaultdict(int), components([i for i, _ in rows], links)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert got == {i: (count[i], parts[i], parts[i] == i) for i, _ in rows}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_calibration():
    half, least = embeddings.calibrate(0.95, 64, 0.9995)
    rng = np.random.default_rng(0)
    lines_ = rng.normal(size=(64, 24, 4000))
    lines_ /= np.linalg.norm(lines_, axis=0)
    d = np.zeros(64)
    d[0] = np.sqrt(2 * 0.05)
    hits = (np.abs(np.einsum("d,dlk->lk", d, lines_)) <= half).sum(0)
    assert (hits >= least).mean() >= 0.999


def brute_lines(rows, ratio, least):
    hosts, seen = defaultdict(int), defaultdict(set)
    for i, (_, host, text) in enumerate(rows):
        hosts[host] += 1
        for line in (text or "").split("\n"):
            if line.strip(" "):
                seen[host, line.strip(" ")].add(i)
    out = []
    for k, host, text in rows:
        bad = lambda x: len(seen[host, x.strip(" ")]) >= least and len(seen[host, x.strip(" ")]) > ratio * hosts[host]  # noqa: B023, E731
        out.append((k, None if text is None else "\n".join(x for x in text.split("\n") if not bad(x))))
    return sorted(out, key=repr)


def test_lines(spark):
    rng = random.Random(8)
    common = ["menu", " footer ", "", "rights"]
    rows = [(i, rng.choice(["a", "a", "b", None, f"h{i}"]), "\n".join([rng.choice(common), f"own {i}", rng.choice(common), rng.choice(common)])) for i in range(120)]
    rows += [(500, "a", None), (501, "a", ""), (502, None, "menu\nmenu\nmenu"), (503, "a", rows[0][2]), rows[0], (None, "b", "menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"host": F.lit(1), "line": F.lit(2), "lines": F.lit(3)})
    out = lines.drop_boilerplate_lines(df, max_ratio=0.2, least=3, removed="n")
    assert out.columns == [*df.columns, "n"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute_lines(rows, 0.2, 3)
    assert lines.drop_boilerplate_lines(df.limit(0)).count() == 0


def test_page_lines(spark):
    html = "<html><head><title>T</title><script>var a='<p>';</script></head><body><!-- x --><p class=\"a\">one <b>two</b><br>three</p>\n<pre>4</pre></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(lines.page_lines(F.col("h"))).first()[0]
    assert [x.strip() for x in got.split("\n") if x.strip()] == ["T", "one  two", "three", "4"]


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.op5_substring_dedup(spark, sf)
    assert out.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    want = [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute_passages(docs, 13)]
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(want)
    six = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_dedup(spark, sf).collect()}
    prints = {k: brute_fingerprint(t, 4) for k, t in docs}
    parts = components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if bin(prints[a] ^ prints[b]).count("1") <= 4])
    assert six == {k: (f"{p:016x}", parts[k]) for k, p in prints.items()}


def test_portions_hold_every_row_once():
    import pyarrow as pa

    from strataframe.llm.common import portions

    texts = pa.array(["x" * n for n in (0, 5, 3_000, 10, 900, 0)] + [None, "y" * 70_000, "z"] + [""] * 30_000)
    cuts = list(portions(texts, 4096))
    assert [a for a, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]] and sum(n for _, n in cuts) == len(texts)
    assert all(n == 1 or sum(len(t or "") for t in texts.slice(a, n).to_pylist()) <= 4096 for a, n in cuts)
    assert max(n for _, n in cuts) <= 4096 and not list(portions(texts.slice(0, 0)))


def test_ranks_have_no_gaps_and_spread_one_key(spark, odd):
    from strataframe.llm.common import gapless_rank

    out = gapless_rank(odd.unionByName(odd), ["source"], ["doc_id"], "rank")
    assert out.columns == [*odd.columns, "rank"]
    by = {}
    for r in out.collect():
        by.setdefault(r.source, []).append((r["rank"], r.doc_id))
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) for v in by.values()) and None in by
    assert all([k for _, k in sorted(v)] == sorted((k for _, k in v), key=lambda k: (k is not None, k or 0)) for v in by.values())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = spark.range(200_000).select(F.lit(1).alias("g"), F.lit(7).alias("key"))
        out = gapless_rank(same, ["g"], ["key"], "rank")
        assert out.agg(F.count_distinct("rank"), F.max("rank")).first() == (200_000, 199_999)
        assert len(out.inputFiles()) == 4  # every task had a range
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert gapless_rank(odd.limit(0), ["source"], ["doc_id"], "rank").count() == 0
