import math
import re

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import TABLES
from trendloom.llm import urls, vectors
from trendloom.llm.queries import RULES

URLS = [None, "", "no mark", "http://", "HTTP://Example.NET/en/x?y#z", "https://a.example.net", "x://a.example.net/enx",
        "https://notexample.com/de/1", "https://B.Example.com/de/#t", "https://example.com?/de/", "ftp://fr.org/fr/",
        "http://org/fr/a://net/", "http://net/", "http://net", "http://a..net//en/", "http://É.org/fr/é", "http://u@h.net:80/a",
        "//net/", "http://net/\nx", "http://a.ORG/FR/", "http://example.net/en/", "http://example.net/en/"]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(brute.LOWER)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit)[1:] if fit else (None, "allow")
    return host, path, rule, verdict


def rules_of(spark, rules):
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


@pytest.mark.parametrize("rules", [RULES, (), (("net", "", "block"), ("net", "", "allow"), ("É.org", "/", "block")),
                                   tuple((f"h{i}.net", f"/{i}", "block") for i in range(300)) + (("a.org", "/FR/", "x"),)])
def test_odd_urls(spark, rules):
    pages = spark.createDataFrame([(i, u, "clash", "c") for i, u in enumerate(URLS)], "page_id int, url string, host string, key string")
    found = {tuple(r) for r in urls.judge_urls(pages, rules_of(spark, rules)).collect()}
    expected = [(h.translate(brute.LOWER), p, v) for h, p, v in rules]
    assert found == {(i, *judged(u, expected)) for i, u in enumerate(URLS)}
    assert urls.judge_urls(pages.limit(0), rules_of(spark, rules)).count() == 0


def test_filter_passes_all_entries_and_few_others(spark):
    entries = spark.range(2000).selectExpr("concat('e', id) AS entry")
    others = spark.range(20_000).selectExpr("concat('o', id) AS key")
    assert urls.possible_hits(entries, "entry", entries, "entry", 2000).count() == 2000
    assert urls.possible_hits(others, "key", entries, "entry", 2000).count() < 400


def test_sample_urls(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    found = {tuple(r) for r in urls.judge_urls(pages, rules_of(spark, RULES)).collect()}
    assert found == {(r.page_id, *judged(r.url, RULES)) for r in pages.collect()}


def brute_vectors(rows, threshold=0.98):
    """rows: (vec_id, vector, label) with distinct ids."""
    good = [(i, np.array(v, float), k) for i, v, k in rows
            if v and k is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    pairs = [(a, b) for x, (a, u, k) in enumerate(good) for b, w, m in good[x + 1:]
             if k == m and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= threshold]
    found = brute.components(pairs, [r[0] for r in rows])
    links = {r[0]: 0 for r in rows}
    for p in pairs:
        for i in p:
            links[i] += 1
    return {(i, links[i], found[i], found[i] == i) for i in links}


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node int, n string")


def test_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(1, a, 1), (2, b, 1), (3, a, 1), (4, [5.0, 0.0, 0.0], 1), (5, a, 2), (6, a, None), (7, None, 1), (8, [0.0] * 3, 1),
            (9, [1.0, None, 0.0], 1), (10, [1.0, float("nan"), 0.0], 1), (11, [float("inf"), 0.0, 0.0], 1), (12, [], 1),
            (13, [1.0], 1), (14, [2.0], 1), (15, [-1.0], 1), (16, [0.0, 1.0, 0.0], 1), (0, [1.0, 0.3, 0.0], 1), (17, [-0.0, 1.0, 0.0], 1)]
    found = vectors.near_vectors(vectors_of(spark, rows))
    assert {tuple(r) for r in found.collect()} == brute_vectors(rows)
    assert vectors.near_vectors(vectors_of(spark, rows).limit(0)).count() == 0
    twice = vectors.near_vectors(vectors_of(spark, [(1, a, 1), (1, a, 1), (None, a, 1)])).collect()
    assert sorted(map(tuple, twice), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize("cell", [2048, 5])
def test_clustered_vectors(spark, cell):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + rng.standard_normal(24) * rng.choice([0, 0.05, 0.15, 0.2])).tolist(), i % 3) for i in range(240)]
    rows = [(i, np.float32(v).tolist(), k) for i, v, k in rows]
    found = {tuple(r) for r in vectors.near_vectors(vectors_of(spark, rows), cell=cell).collect()}
    expected = brute_vectors(rows)
    assert found == expected and 0 < sum(r[1] for r in expected) < 240 * 79


def test_sample_vectors(spark):
    table = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(1)
    rows += [(10_000 + i, np.float32(np.array(v) + rng.standard_normal(64) * 0.02).tolist(), k) for i, v, k in rows[:100]]
    found = {tuple(r) for r in vectors.near_vectors(vectors_of(spark, rows)).collect()}
    assert found == brute_vectors(rows)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(9)
    units = vectors.unit(rng.standard_normal((200, 64)))
    signs, factors = vectors.encode(units, 2)
    turned = units @ vectors.rotations(64, 2).T
    codes = (signs * 2.0 - 1) * np.repeat(1 / (factors * 8 * 2), 64, axis=1)
    error = codes @ turned.T - units @ units.T
    np.fill_diagonal(error, 0)
    spread = np.sqrt((1 / factors**2 - 1).mean(axis=1) / (2 * 63))
    assert abs(error.mean()) < 0.002
    assert (np.abs(error) < 5 * spread[:, None]).all()


def test_packed_bits_leave_out_strangers_and_keep_neighbours():
    rng = np.random.default_rng(5)
    for dim in (2, 3, 64, 100):
        a = vectors.unit(rng.standard_normal((300, dim)))
        b = rng.standard_normal((300, dim))
        b = vectors.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        b = 0.98 * a + math.sqrt(1 - 0.98**2) * b
        code = np.packbits(vectors.encode(np.concatenate([a, b]), 2)[0], axis=1)
        none, parts = np.zeros((600, 0), np.int64), np.repeat([0, 1], 300)
        assert vectors.close_rows(code, 2 * dim, none, 0, parts, True, 0.98).all()
        assert not vectors.close_rows(code, 2 * dim, none, 0, parts * 0, True, 0.98).any()
    code = np.packbits(vectors.encode(vectors.unit(rng.standard_normal((300, 64))), 2)[0], axis=1)
    assert not vectors.close_rows(code, 128, none, 0, parts, False, 0.98).any()
    twice = np.concatenate([code, code[:1]])  # met before, in table 0
    assert vectors.close_rows(twice, 128, np.zeros((301, 1), np.int64), 0, parts, False, 0.98).sum() == 2
    assert not vectors.close_rows(twice, 128, np.zeros((301, 1), np.int64), 1, parts, False, 0.98).any()


def test_recall_at_the_threshold():
    bits, tables = vectors.tables_for(1_000_000, 0.98, 0.9999)
    rng = np.random.default_rng(4)
    a = vectors.unit(rng.standard_normal((2000, 64)))
    b = rng.standard_normal((2000, 64))
    b = vectors.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b
    count = max(2, -(-bits * tables // 64))
    keys = [vectors._keys(vectors.encode(x, count)[0], bits, tables) for x in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.995
