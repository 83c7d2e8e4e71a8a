"""Vectors, encoders and the two scoring kernels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import vectors as vec
from trendloom.functions.encoders import hash_encoder, model_encoder
from trendloom.operators import aggregates as agg, similarity
from trendloom.operators.corpus import embed_texts
from trendloom.operators.similarity import similarity_join


def array(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<double>")


def test_dot_norm_cosine(value):
    assert value(vec.dot(array(1, 2), array(3, 4))) == 11
    assert value(vec.cosine(array(3, 0), array(4, 0))) == 1
    assert value(vec.cosine(array(0, 0), array(4, 0))) == 0
    assert value(vec.cosine(F.lit(None).cast("array<double>"), array(1))) == 0
    assert value(vec.l2_normalize(array(3, 4))) == [0.6, 0.8]
    assert value(vec.l2_normalize(array(0, 0))) == [0, 0]


def test_weighted_nan_is_missing(value):
    assert value(vec.weighted(F.lit(0.5), F.lit(2.0))) == 1
    assert value(vec.weighted(F.lit(float("nan")), F.lit(2.0))) is None


@pytest.mark.parametrize("text, expected", [
    ("[1.0, -2.5e-1]", [1.0, -0.25]), ("[ 1.0  2.0\n 3 ]", [1.0, 2.0, 3.0]), ("[1, x]", None), (None, None)])
def test_parse_vector(value, text, expected):
    assert value(vec.parse_vector(F.lit(text).cast("string"))) == expected


def test_hash_encoder(value):
    encode = hash_encoder(16)
    v = value(encode(F.lit("red red dress")))
    assert math.isclose(sum(x * x for x in v), 1.0) and len(v) == 16
    assert value(encode(F.lit("dress red red"))) == v
    assert value(encode(F.lit(""))) == [0.0] * 16
    assert value(encode(F.lit(None).cast("string"))) is None


def test_model_encoder_runs_on_distinct_texts(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype="float32")
        return predict

    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id long, t string")
    got = {r["id"]: r["v"] for r in embed_texts(rows, "t", model_encoder(make, 2), "v").collect()}
    unit = math.sqrt(0.5)
    assert got[1] == got[3] == pytest.approx([unit, unit]) and got[2] == [1, 0] and got[4] is None


def test_model_encoder_gets_no_null_and_may_cut(spark):
    def make():
        def predict(texts):
            assert not any(t is None for t in texts)
            return np.array([[3.0 * len(t), 4.0 * len(t)] if len(t) <= 3 else [1.0, 0.0] for t in texts], dtype="float32")
        return predict

    rows = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "")], "id long, t string")
    encode = model_encoder(make, max_chars=3)
    got = {r["id"]: r["v"] for r in rows.select("id", encode(F.col("t")).alias("v")).collect()}
    assert got == {1: pytest.approx([0.6, 0.8]), 2: None, 3: [0.0, 0.0]}


def test_mean_pool_with_mask(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0),
                                  ("b", [5.0, 5.0], 0)], "k string, v array<double>, m int")
    got = {r["k"]: r["embedding"] for r in agg.mean_pool(rows, ["k"], "v", 2, "m").collect()}
    assert got == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    uneven = rows.union(spark.createDataFrame([("a", [1.0, 2.0, 3.0], 1)], rows.schema))
    for dim in (2, None):
        with pytest.raises(Exception, match="differ in length"):
            agg.mean_pool(uneven.coalesce(1), ["k"], "v", dim).collect()
    two = agg.mean_pool(spark.createDataFrame([("x", None, [1.0]), ("x", 2, [3.0]), ("x", None, [5.0])],
                                              "a string, b int, v array<double>"), ["a", "b"], "v")
    assert {(r["a"], r["b"], tuple(r["embedding"])) for r in two.collect()} == {("x", None, (3.0,)), ("x", 2, (3.0,))}


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_mean_pool_checks_lengths_by_key(spark, partitions):
    """Whatever lies together: one key with two lengths fails, keys with lengths of their own do not."""
    kinds = "k string, v array<double>"
    uneven = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])] * 5 + [("a", [1.0, 2.0, 3.0])], kinds)
    with pytest.raises(Exception, match="differ in length"):
        agg.mean_pool(uneven.repartition(partitions), ["k"], "v").collect()
    own = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0]), ("a", [3.0, None]), ("c", []), ("d", None)] * 3, kinds)
    got = {r["k"]: r["embedding"] for r in agg.mean_pool(own.repartition(partitions), ["k"], "v").collect()}
    assert got == {"a": [2.0, 1.0], "b": [4.0], "c": []}
    with pytest.raises(Exception, match="differ in length"):
        agg.mean_pool(own.where("k <> 'd'").repartition(partitions), ["k"], "v", 2).collect()


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)

    def unit():
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    # most items share one category
    items = [(i, "hot" if i % 3 else f"c{i % 5}", unit() if i % 11 else None,
              rng.choice([0.0, 0.5, 1.0, -1.0, None])) for i in range(300)]
    tags = [(f"t{i}", "hot" if i % 2 else f"c{i % 5}", unit(), 0.3 if i % 4 == 0 else None) for i in range(40)]
    return (spark.createDataFrame(items, "id long, category string, text_embedding array<double>, confidence double"),
            spark.createDataFrame(tags, "tag string, category string, embedding array<double>, floor double"),
            items, tags)


def brute(items, tags, weighted, above, floor, by_category=True):
    out = {}
    for i, c, v, w in items:
        for t, tc, tv, f in tags:
            if v is None or (by_category and c != tc) or (weighted and w is None):
                continue
            s = round(sum(a * b for a, b in zip(v, tv)) * (w if weighted else 1.0), 9)
            if (above is None or s > above) and (not floor or f is None or s >= f):
                out[i, t] = s
    return out


@pytest.mark.parametrize("kernel", ["arrow", "native"])
@pytest.mark.parametrize("weighted, above, floor, on", [
    (False, 0.0, False, "category"), (True, 0.0, True, "category"), (True, 0.1, False, "category"),
    (False, 0.4, False, None)])
def test_kernels_against_brute_force(sides, kernel, weighted, above, floor, on, monkeypatch):
    items, tags, item_rows, tag_rows = sides
    monkeypatch.setattr(similarity, "CELLS_PER_STEP", 64)
    monkeypatch.setattr(similarity, "TAGS_PER_BLOCK", 3)
    got = similarity_join(items, tags, ["id"], weight="confidence" if weighted else None, on=on, above=above,
                          floor="floor" if floor else None, kernel=kernel)
    assert ("category" in got.columns) == (on is not None)
    got = {(r["id"], r["tag"]): r["score"] for r in got.collect()}
    expected = brute(item_rows, tag_rows, weighted, above, floor, on is not None)
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=2e-9) for k in got)


@pytest.mark.parametrize("bound", [40, 39, 10, 1])
def test_tags_beyond_the_bound_are_taken_in_blocks(sides, monkeypatch, bound):
    items, tags, item_rows, tag_rows = sides
    monkeypatch.setattr(similarity, "BLOCK_TAGS", bound)
    got = similarity_join(items, tags, ["id"], weight="confidence", floor="floor")
    assert {(r["id"], r["tag"]): r["score"] for r in got.collect()} == {
        k: pytest.approx(v, abs=2e-9) for k, v in brute(item_rows, tag_rows, True, 0.0, True).items()}


@pytest.mark.parametrize("kernel", ["arrow", "native"])
def test_vectors_of_different_lengths_are_refused(sides, kernel):
    items, tags, _, _ = sides
    short = tags.withColumn("embedding", F.slice("embedding", 1, 7))
    with pytest.raises(Exception, match="differ in length"):
        similarity_join(items, short, ["id"], kernel=kernel).collect()
    with pytest.raises(ValueError):
        similarity_join(items, tags, ["id"], kernel="other")


def test_no_tags_no_scores(sides):
    items, tags, _, _ = sides
    assert similarity_join(items, tags.where("false"), ["id"]).count() == 0


def test_unit_vectors_score_at_most_one(sides):
    items, tags, _, _ = sides
    top = similarity_join(items, tags, ["id"], above=None).agg(F.max(F.abs("score"))).first()[0]
    assert top <= 1.0


def test_max_score_skips_nan(spark):
    rows = spark.createDataFrame(
        [("c", 1, "t", float("nan")), ("c", 1, "t", 0.4), ("c", 2, "t", float("nan")), (None, 3, "t", 1.0)],
        "category string, product_id long, tag string, score double")
    got = {r["product_id"]: r["confidence"] for r in agg.max_score(rows).collect()}
    assert got == {1: 0.4, 2: None}
