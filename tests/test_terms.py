"""Terms counted in tasks and the pruned ranking against the column functions and plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataframe.functions import text as fn
from strataframe.operators import intel, terms

SCHEMA = "document_id string, page_id long, chunk_id long, text string, page_number int, evidence_type string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    words = ["coal", "seam", "the", "of", "İstanbul", "KELVIN", "Kelvin", "a1-b", "x", "ab", "abc", "deadbeef00112233", "2019", "mine-shaft", "mine", "déjà", "ÉCOLE", "coal.", "type", "\n", "q9", "-", "one"] + [f"rare{i}" for i in range(300)]
    rows = [(f"d{i % 7}", i % 7 + 7 * (i // 14), i, " ".join(rng.choices(words, [60] * 23 + [1] * 300, k=rng.randint(0, 80))), i % 5, "SOURCE_DOCUMENT") for i in range(400)]
    return spark.createDataFrame([*rows, ("d1", None, 900, None, None, None), ("d1", 5, 901, "", 1, None)], SCHEMA).repartition(6)


def test_both_forms_of_the_rules_agree(spark, chunks):
    got = Counter({(r.chunk_id, r.term): r.n for r in terms.chunk_terms(chunks).collect()})
    want = Counter((r.chunk_id, r.term) for r in chunks.select("chunk_id", F.explode(fn.terms(F.col("text"))).alias("term")).collect())
    assert got == want and any(" " in t for _, t in want)
    pairs = Counter({(r.chunk_id, r.term): r.n for r in terms.chunk_terms(chunks, pairs_only=True, only=["coal seam", "seam coal"]).collect()})
    assert pairs == Counter({k: n for k, n in want.items() if k[1] in ("coal seam", "seam coal")})


@pytest.mark.parametrize("sample,likely,bins,limit", [(2000, 10, 1 << 16, 20), (30, 1, 64, 20), (5, 1, 1 << 16, 7), (400, 2, 8, 500), (1, 1, 16, 3)])
def test_pruning_loses_no_term(spark, chunks, monkeypatch, sample, likely, bins, limit):
    monkeypatch.setattr(terms, "SAMPLE", sample)
    monkeypatch.setattr(terms, "LIKELY", likely)
    every = [(r.document_id, r.page_id, r.chunk_id, r.term, r.n) for r in terms.chunk_terms(chunks).collect()]
    frequency, tokens = Counter(t for *_, t, _ in every), Counter()
    for *_, t, n in every:
        tokens[t] += n
    documents = Counter(t for _, t in {(d, t) for d, _, _, t, _ in every})
    pages = Counter(t for _, t in {(p, t) for _, p, _, t, _ in every if p is not None})
    want = sorted(frequency, key=lambda t: (-frequency[t], t))[:limit]
    got = intel.keywords(chunks, limit).collect()
    assert {r.term: (r.frequency, r.token_frequency, r.document_count, r.page_count) for r in got} == {t: (frequency[t], tokens[t], documents[t], pages[t]) for t in want}
    topics = sorted((t for t in frequency if " " in t), key=lambda t: (-frequency[t], t))[:limit]
    assert {r.term: (r.frequency, r.document_count) for r in intel.topics(chunks, limit).collect()} == {t: (frequency[t], documents[t]) for t in topics}


def test_few_terms_are_shuffled(spark):
    """Most different terms are never passed on."""
    rng = random.Random(1)
    rows = [("d", i, i, " ".join(f"common{rng.randrange(30)} seldom{rng.randrange(20_000)}" for _ in range(40)), 1, "S") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    likely, heavy = terms.candidates(df, 20)
    every, passed = terms.summed_terms(df, ()).count(), terms.summed_terms(df, (), likely=likely, heavy=heavy).count()
    assert passed < every / 5


def test_evidence_has_provenance(spark, chunks):
    ranked = intel.keywords(chunks, 5)
    rows = {r.term: r.evidence for r in intel.evidence(chunks, ranked).collect()}
    where = {r.chunk_id: r for r in chunks.collect()}
    held = {}
    for r in terms.chunk_terms(chunks).collect():
        held.setdefault(r.term, []).append((r.document_id, r.chunk_id))
    assert len(rows) == 5
    for term, found in rows.items():
        assert [(e.document_id, e.chunk_id) for e in found] == sorted(held[term])[:5]
        assert all((e.page_id, e.page_number, e.evidence_type) == (where[e.chunk_id].page_id, where[e.chunk_id].page_number, where[e.chunk_id].evidence_type) for e in found)


def test_no_chunks(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not intel.keywords(none).count() and not intel.topics(none).count() and not intel.keywords(none, 5, ("document_id",)).count() and not intel.evidence(none, intel.keywords(none)).count()


def test_one_document_is_not_compared(spark, chunks):
    one = chunks.where("document_id = 'd1'")
    assert tuple(intel.comparison_status(one).first()) == ("INSUFFICIENT_EVIDENCE", None, 1) and not intel.compare_documents(one).count()
    assert tuple(intel.comparison_status(chunks).first()) == ("COMPLETED", "INSUFFICIENT_VERIFIED_DATA", 7) and intel.compare_documents(chunks).count()


def test_keywords_of_documents_search_the_texts_once(spark):
    rows = [("a", 1, 1, "coal seam coal"), ("a", 1, 2, "coal ash"), ("a", 2, 3, "coal seam"), ("b", 3, 4, "seam"), (None, 4, 5, "ash ash")]
    chunks = spark.createDataFrame(rows, "document_id string, page_id int, chunk_id int, text string")
    lean = intel.keywords(chunks, 2, ("document_id",), page_counts=False)
    assert lean._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    full = intel.keywords(chunks, 2, ("document_id",))
    got = {(r.document_id, r.term): (r.frequency, r.token_frequency, r.document_count, r.page_count, r.weight) for r in full.collect()}
    assert got == {("a", "coal"): (3, 4, 1, 2, 1.0), ("a", "coal seam"): (2, 2, 1, 2, 0.666667), ("b", "seam"): (1, 1, 1, 1, 1.0), (None, "ash"): (1, 2, 1, 1, 1.0)}
    assert {tuple(r) for r in lean.collect()} == {tuple(r) for r in full.drop("page_count").collect()}
