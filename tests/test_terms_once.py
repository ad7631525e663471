"""Ranked terms from one search of the texts, and first chunks and sums made in the tasks that search them."""

import random
from collections import Counter

import pytest

from strataframe.operators import intel, reports, terms

SCHEMA = "document_id string, page_id long, chunk_id long, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)] + ["the", "of", "coal", "seam"]
    rows = [(f"d{i % 5}", i, i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    return spark.createDataFrame([*rows, (None, None, 900, "coal seam coal"), ("d1", 5, None, "seam coal seam"), ("d2", 5, 901, None)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def held(chunks):
    return {(r.document_id, r.chunk_id, r.term) for r in terms.chunk_terms(chunks).collect()}


@pytest.mark.parametrize("sample,likely,limit", [(2000, 10, 20), (3, 1, 20), (1, 1, 3), (2000, 10, 5000)])
def test_ranked_terms(chunks, held, monkeypatch, sample, likely, limit):
    monkeypatch.setattr(terms, "SAMPLE", sample)
    monkeypatch.setattr(terms, "LIKELY", likely)
    n = sorted(Counter(t for *_, t in held).items(), key=lambda x: (-x[1], x[0]))
    pairs, every = terms.ranked_terms(chunks, limit, (True, False))
    assert every == n[:limit] and pairs == [x for x in n if " " in x[0]][:limit]


def test_tasks_pass_on_their_first_chunks(chunks, held):
    """A row for each chunk that holds a term was passed on before."""
    wanted = ["coal", "seam coal", "word1", "the", "coal coal", "a b c", "none"]
    rows = terms.first_chunks(chunks, wanted, 2).collect()
    assert len(rows) <= 5 * 2 * 3
    order = lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0)
    want = {t: sorted(((d, c) for d, c, x in held if x == t), key=order)[:2] for t in wanted[:3]}
    ranked = chunks.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    assert {r.term: [(e.document_id, e.chunk_id) for e in r.evidence] for r in intel.evidence(chunks, ranked, 2).collect()} == want


def test_distribution_is_added_up_in_tasks(spark, chunks, held):
    ranked = spark.createDataFrame([("coal",), ("word2 word3",)], "term string")
    out = intel.distribution(chunks, ranked)
    assert {(r.term, r.document_id): r.frequency for r in out.collect()} == Counter((t, d) for d, _, t in held if t in ("coal", "word2 word3"))
    assert terms.summed_terms(chunks, ("document_id",), likely=["coal"], occurrences=False).count() <= 5 * 6


def test_topics_of_documents_are_searched_once(spark, chunks):
    out = intel.frequency_changes(chunks, 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # there were two
    own = {(r.term, r.document_id): r.frequency for r in intel.document_topics(chunks, 3).collect() if r.document_id is not None}
    names = {t for t, _ in own} | {r.term for r in intel.document_topics(chunks, 3).collect()}
    assert {(r.term, r.document_id): r.frequency for r in out.collect()} == {(t, d): own.get((t, d), 0) for t in names for d in (None, "d0", "d1", "d2", "d3", "d4")}


def test_report_searches_texts_for_its_evidence_once(chunks):
    out = reports.document_report(chunks, 5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0  # found once; it stood twice in the plan
    assert {r.section for r in out.collect()} == {"topics", "keywords"} and all(len(r.citations) == 5 for r in out.collect())


def test_held_terms_are_passed_on_in_one_batch(chunks, monkeypatch):
    monkeypatch.setattr(terms, "HELD", 50)
    some = Counter()
    for r in terms.summed_terms(chunks, ("document_id", "page_id")).collect():
        some[(r.document_id, r.term)] += r.f
    want = Counter((r.document_id, r.term) for r in terms.chunk_terms(chunks).collect())
    assert some == want
