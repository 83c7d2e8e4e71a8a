import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm import brute
from tests.llm.conftest import ODD
from trendloom.llm import search
from trendloom.llm.search import Block, Query, rank_documents


def terms(text):
    return brute.NORMAL.findall((text or "").translate(brute.LOWER))


def plain(rows, items, top=20):
    """(item_id, rank, doc_id, score), every document scored."""
    docs = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in rows) if w]
    n, length = len(docs), sum(x for _, _, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, counts, size in docs:
            m = 100 - 25 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) *
                        (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in rank_documents(docs, items, **options)
                   .select("item_id", "rank", "doc_id", "score").collect()), key=str)


@given(st.lists(st.lists(st.integers(0, 6), max_size=5), min_size=1, max_size=40), st.integers(1, 6),
       st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_block_against_all_scores(lists, top, asked, step):
    """Impacts of few values, so ties abound; each document gives its impacts for terms 0 to 5."""
    ids = np.array([i // 2 if step == 0 else i * step - 5 for i in range(len(lists))], object)
    rows = [(t, place, value) for place, values in enumerate(lists) for t, value in enumerate(values)]
    columns = [np.array(c, np.int64) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 3
    block = Block(ids, *columns, 6)
    times = Counter(asked)
    query = Query(np.array(list(times), np.int64), np.array(list(times.values()), np.int64))
    best = []
    block.search(query, best, top)
    scores = [(sum(n * v[t] for t, n in times.items() if t < len(v)), -ids[i]) for i, v in enumerate(lists)]
    wanted = sorted((s for s in scores if s[0] > 0), reverse=True)[:top]
    assert sorted((s for s in best if s[0] > 0), reverse=True) == wanted


def test_range_maxima():
    values = np.random.default_rng(3).integers(1, 9, 100)
    block = Block(np.arange(100).astype(object), np.zeros(100, np.int64), np.arange(100), values, 1)
    for a in range(0, 100, 3):
        for b in range(a + 1, 101, 5):
            assert block.greatest(np.array([a]), np.array([b]))[0] == a + values[a:b].argmax()


def test_most_documents_are_not_scored():
    rng = np.random.default_rng(5)
    docs, terms_ = np.repeat(np.arange(20_000), 3), np.tile(np.arange(3), 20_000)
    block = Block(np.arange(20_000).astype(object), terms_, docs, (rng.pareto(2, 60_000) * 1000).astype(np.int64) + 1, 3)
    best = []
    scored = block.search(Query(np.arange(3), np.ones(3, np.int64)), best, 20)
    assert len(best) == 20 and scored < 4000


def test_copies_are_not_all_scored():
    """Thousands of equal scores: those of the least ids are taken, and no more looked at than need be."""
    n = 10_000
    block = Block(np.arange(n).astype(object), np.zeros(n, np.int64), np.arange(n), np.full(n, 7), 1)
    best = []
    scored = block.search(Query(np.array([0]), np.array([2])), best, 20)
    assert sorted(best, reverse=True) == [(14, -i) for i in range(20)] and scored < 200


def test_sample(spark, sample):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert found(sample, items) == plain(rows, asked)


@pytest.mark.parametrize("options", [{}, {"postings": 10}, {"block_bytes": 30}, {"top": 1}, {"top": 3, "postings": 1}])
def test_odd_rows(spark, documents, options):
    rows = [*ODD, (5, "one"), (5, "one two"), (None, "one"), (None, "one a"), (30, "same one two z"), (31, "12 3 x")]
    docs = documents(rows).withColumnRenamed("fp", "a.b").withColumnRenamed("n_words", "score").repartition(3)
    asked = [(1, "one ONE two"), (1, "z y x 12"), (None, "lorem Same"), (4, None), (5, ""), (6, "nowhere"), (7, "ß ÄÖ same a"),
             (8, "one ONE two")]
    items = spark.createDataFrame([(i, t, 0) for i, t in asked], "item_id int, text string, rank int")
    got = found(docs, items, **options)
    assert got == plain(rows, [a for a in asked if a[1] is not None], options.get("top", 20))


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert found(documents(ODD).limit(0), items) == []
    assert found(documents([(1, None), (2, "..")]), items) == []
    assert found(documents(ODD), items.limit(0)) == []
    assert search.TOP == 20
