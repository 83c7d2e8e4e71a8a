import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm import brute
from tests.llm.conftest import ODD
from trendloom.llm import components, simhash, substring, words
from trendloom.llm.decontaminate import contamination, remove_passages


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 23))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_hashes(text, size):
    hashes = words.window_hashes(words.word_hashes(text), size)
    assert len(hashes) == max(0, len(text) - size + 1)
    seen = {}
    for i, h in enumerate(hashes.tolist()):
        assert seen.setdefault(h, text[i:i + size]) == text[i:i + size]
    assert len(seen) == len({tuple(text[i:i + size]) for i in range(len(hashes))})


@given(st.lists(st.integers(0, 9), min_size=1, max_size=50), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_sliding_minimum(values, size):
    if size <= len(values):
        found = words.sliding_minimum(np.array(values), size).tolist()
        assert found == [min(values[i:i + size]) for i in range(len(values) - size + 1)]


@given(st.lists(st.sampled_from([b"a", b"b"]), min_size=20, max_size=80))
@settings(max_examples=60, deadline=None)
def test_anchors_are_the_places_of_minimisers(text):
    runs, least = substring.minimisers(words.word_hashes(text), 20, 5)
    places = {p for i, m in enumerate(least) for p in range(i, i + 16) if runs[p] == m}
    assert sorted(substring.anchors(b" ".join(text)).tolist()) == sorted(int(runs[p]) for p in places)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, 300)]
    for i in range(300):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    groups = np.sort(rng.integers(0, 4, 300))
    found = {p for left, right in simhash.linked(fps, groups, radius) for p in zip(left.tolist(), right.tolist())}
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300)
                     if groups[i] == groups[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)]
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a bigint, b bigint")
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    found = {tuple(r) for r in components.connected_components(edges).collect()}
    assert found == set(brute.components([p for p in pairs if p[0] != p[1]], nodes).items())
    assert components.connected_components(edges.limit(0)).count() == 0


def test_near_duplicates_odd(documents, rows_of):
    found = rows_of(simhash.near_duplicates(documents(ODD)), "doc_id", "fingerprint", "component_id")
    assert found == brute.near_duplicates(ODD)


def test_near_duplicates_sample(sample, rows_of):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    rows += [(10_000 + d, (t or "").replace(" the ", " a ", 1)) for d, t in rows[:60]]
    docs = sample.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute.near_duplicates(rows)
    assert len({r[2] for r in expected}) < len(expected)
    for cell in (2048, 2):  # with cells of two, every crowded bucket is dealt out
        found = simhash.near_duplicates(docs, cell=cell)
        assert rows_of(found, "doc_id", "fingerprint", "component_id") == expected


def test_repeated_words_odd(documents, rows_of):
    columns = "doc_id", "n_words", "n_removed", "kept_sha256"
    assert rows_of(substring.repeated_words(documents(ODD)), *columns) == brute.repeats(ODD)


def test_repeated_words_sample(sample, rows_of):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    found = rows_of(substring.repeated_words(sample), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute.repeats(rows)


def test_factors_cover_what_is_removed(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, f"x {text} y"), (1, text), (None, "q"), (2, f"x {text} y")],
                                 "doc_id bigint, text string")
    found = {r.doc_id: r for r in substring.repeated_words(docs).collect()}
    assert (found[2].starts, found[2].lengths, found[2].n_removed) == ([1], [60], 60)
    assert found[1].n_removed == 0
    assert substring.repeated_words(docs).count() == 4


def test_remove_repeats_keeps_the_columns(documents):
    text = " ".join(f"w{i}" for i in range(30))
    docs = documents([(1, f"Start {text}. end"), (2, f"Other  {text}. tail"), (3, None)])
    rows = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert rows[1].text.startswith("Start") and rows[1].n_chars == 0
    assert rows[2].text == "Other  w29. tail" or rows[2].text == "Other  tail"
    assert rows[2].n_chars == len(rows[2].text) and rows[3].text is None
    assert substring.remove_repeats(docs).schema == docs.schema


def test_contamination_odd(spark, documents, rows_of):
    items = [(1, "one two"), (2, None), (3, "..."), (None, "b c d e f g h i j k l"), (5, "same"), (5, "same"),
             (6, "x y z 12 3"), (7, "lorem ipsum " * 6)]
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    test = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute.contamination(ODD, items)
    assert rows_of(contamination(documents(ODD), test), *columns) == expected
    assert rows_of(contamination(documents(ODD), test, block_bytes=20), *columns) == expected
    none = rows_of(contamination(documents(ODD), test.limit(0)), *columns)
    assert none == brute.contamination(ODD, [])


def test_contamination_sample(spark, sample, rows_of):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute.contamination([(r.doc_id, r.text) for r in sample.collect()],
                                   [(r.item_id, r.text) for r in items.collect()])
    found = rows_of(contamination(sample, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == expected and any(r[-1] for r in found)


def test_remove_passages(spark, documents):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    docs = documents([(1, "Start. A b, c d\ne f g h I j! End."), (2, "clean a b c"), (3, None)])
    rows = {r.doc_id: r for r in remove_passages(docs, items).collect()}
    assert rows[1].text == "Start. , ! End." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean a b c" and rows[2].n_chars == 0 and rows[3].text is None
    whole = remove_passages(docs, items, whole_documents=True)
    assert {r.doc_id for r in whole.collect()} == {2, 3} and whole.columns == docs.columns


def test_remove_passages_takes_all_blocks_at_once(spark, documents):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[5:20])), (2, " ".join(words[15:28])), (3, " ".join(words[28:38]))],
                                  "item_id bigint, text string")
    joined = " ".join(words[:5] + words[5:10] + words[28:33])  # a cut may not make a window
    docs = documents([(1, " ".join(words)), (1, " ".join(words)), (2, joined), (3, None), (4, "Clean, this.")])
    one, many = (remove_passages(docs, items, block_bytes=size) for size in (1 << 20, 20))
    assert many.schema == docs.schema and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert [r.text for r in many.where("doc_id = 1").collect()] == [" ".join(words[:5] + words[38:])] * 2
    assert {r.n_chars for r in many.where("doc_id = 1").collect()} == {len(" ".join(words[:5] + words[38:]))}
    whole = remove_passages(docs, items, block_bytes=20, whole_documents=True)
    assert sorted(r.doc_id for r in whole.collect()) == [2, 3, 4]


def test_each_row_has_a_result_with_any_number_of_blocks(spark, documents):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")], "item_id bigint, text string")
    rows = [(1, "a b c d e f g h i j x"), (1, "a b c d e f g h i j x"), (2, None), (2, None), (None, "k l"), (None, "k l"), (3, "y")]
    one, many = (contamination(documents(rows), items, block_bytes=size).collect() for size in (1 << 20, 10))
    assert len(one) == len(rows) and sorted(map(str, one)) == sorted(map(str, many))
