"""The registered queries against restatements over whole small tables."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_tokens_and_models import brute_leaks, crc
from tokenizers import Tokenizer

from strataframe.llm import queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}


def test_token_files(spark, docs):
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k] or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    out = queries.op2_token_files(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == want


def test_packed_pieces(spark, docs):
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for k, t in docs.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((k, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    assert len(sequences) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_leaks(spark, docs):
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()} == brute_leaks(list(docs.items()), items)


def drawn(key, tree, seed=7):
    """The shard of a key, restated: at each level the child of least ``-ln(u) / weight``."""

    def child(weights, *path):
        draws = []
        for i, w in enumerate(weights):
            h = xxhash.xxh64_intdigest(str(key).encode(), 42)
            for p in (seed, *path, i):
                h = xxhash.xxh64_intdigest(struct.pack("<i", p), h)
            draws.append(-math.log(((h >> 11) + 0.5) * 2.0**-53) / w if w > 0 else math.inf)
        return int(np.argmin(draws))

    region = child([sum(map(sum, r)) for r in tree])
    rack = child([sum(k) for k in tree[region]], region)
    leaf = child(tree[region][rack], region, rack)
    return sum(len(k) for r in tree[:region] for k in r) + sum(map(len, tree[region][:rack])) + leaf


def test_shards(spark, docs):
    rows = queries.op10_sharding(spark, SF).collect()
    tree = sharding.uniform_tree(40)
    grown = sharding.grow(tree)
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = {}
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
        assert (r.shard, r.grown_shard) == (drawn(r.doc_id, tree), drawn(r.doc_id, grown))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stripped_pages(spark):
    """Lines go on hosts of three pages or more, small hosts included."""
    sf = "/root/testdata/sf0.01"
    removed = {r.page_id: r.n_removed for r in queries.op9_line_dedup(spark, sf).collect()}
    pages = queries.table(spark, sf, "pages").select("page_id", "url").collect()
    host = {p.page_id: re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", p.url)[1].lower() for p in pages}
    sizes = Counter(host.values())
    assert set(removed) == set(host) and all(n == 0 or sizes[host[p]] >= 3 for p, n in removed.items())
    assert any(n and sizes[host[p]] < 20 for p, n in removed.items())
