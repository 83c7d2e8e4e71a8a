import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import aggregates as agg, best, similarity
from trendloom.operators.ranking import top_k

ITEMS, PRODUCTS, TAGS = 4000, 900, 23


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(11)

    def unit(n):
        x = rng.normal(size=(n, 12))
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()

    vectors = unit(300)  # the same vectors again and again, so that scores tie
    items = [(f"p{rng.integers(PRODUCTS)}", "abc"[min(int(rng.integers(6)), 2)], vectors[rng.integers(300)],
              float(np.round(rng.random() * 2 - 0.3, 2))) for _ in range(ITEMS)]
    items += [(None, "a", vectors[0], 1.0), ("p1", None, vectors[0], 1.0), ("p1", "a", None, 1.0), ("p1", "a", vectors[1], None),
              ("p1", "nowhere", vectors[0], 1.0), ("p2", "a", vectors[0], float("nan"))]
    tags = [(g, f"t{i}", v, 0.1 * (i % 4)) for g in "abd" for i, v in enumerate(unit(TAGS))]
    return (spark.createDataFrame(items, "product_id string, category string, text_embedding array<double>, weight double").repartition(5),
            spark.createDataFrame(tags, "category string, tag string, embedding array<double>, floor double"))


def rows(df):
    return sorted(tuple(r) for r in df.select("category", "product_id", "tag", F.round("confidence", 8)).collect())


def plainly(items, tags, floor):
    pairs = similarity.similarity_join(items, tags, ["product_id"], weight="weight", floor=floor, kernel="native")
    return agg.max_score(pairs)


@pytest.mark.parametrize("floor", [None, "floor"])
def test_maxima_are_those_of_all_pairs(sides, floor):
    items, tags = sides
    found = best.best_pairs(items, tags, weight="weight", floor=floor)
    assert rows(agg.max_score(found)) == rows(plainly(items, tags, floor))


def test_a_row_per_product_tag_and_batch(spark, sides):
    """With batches of all rows of a task: the kernel gives as many rows as there are maxima in the tasks."""
    items, tags = sides
    items = items.repartition(3, "product_id").persist()
    pairs = similarity.similarity_join(items, tags, ["product_id"], weight="weight")
    found = best.best_pairs(items, tags, weight="weight")
    maxima = agg.max_score(found).count()
    assert found.count() == maxima < pairs.count()
    items.unpersist()


@pytest.mark.parametrize("k", [1, 7, 40, 10_000])
@pytest.mark.parametrize("held", [1 << 22, 100])
def test_k_best(spark, sides, monkeypatch, k, held):
    """Equal to ranking all maxima, with ties; no more than k rows of a tag leave a task."""
    monkeypatch.setattr(best, "HELD_ROWS", held)
    items, tags = sides
    found = best.best_pairs(items, tags, weight="weight", k=k).withColumn("task", F.spark_partition_id()).persist()
    assert found.groupBy("task", "category", "tag").count().where(F.col("count") > k).count() == 0
    assert rows(top_k(agg.max_score(found), k=k)) == rows(top_k(plainly(items, tags, None), k=k))
    found.unpersist()


def test_weak_rows_are_not_multiplied(sides):
    """|score| is no more than the weight, so a floor above all weights leaves nothing to do."""
    keeper = best.Keeper(np.array([0.9, 0.8]), 0.0, 9, None)
    matrix = np.eye(2)
    import pyarrow as pa

    batch = pa.record_batch({"product_id": ["a", "b", "c"], "__vec": [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]],
                             "__weight": [0.5, 0.85, 0.79]})
    taken = list(best._vector_rows("product_id", 100)(batch, (None, matrix, None), keeper))
    assert [p.to_pylist() for p, _ in taken] == [["b"]]


def test_held_lists_raise_the_bar():
    import pyarrow as pa

    keeper = best.Keeper(np.array([np.nan]), 0.0, 9, 2)
    for names, scores in ((["b", "a", "c"], [0.5, 0.5, 0.5]), (["b", "d"], [0.9, 0.1])):
        keeper.hold(keeper.best(pa.array(names), np.array(scores)[:, None]))
    held = keeper.prune()
    assert held.column("p").to_pylist() == ["b", "a"] and held.column("s").to_pylist() == [0.9, 0.5]
    assert keeper.kth.tolist() == [0.5] and keeper.reach() == pytest.approx(0.5)
    assert len(keeper.best(pa.array(["x"]), np.array([[0.4]]))[0]) == 0


def test_texts_scored_once(spark, sides):
    items, tags = sides
    texts = items.where("category is not null and text_embedding is not null").select("category", "text_embedding").distinct()
    texts = texts.withColumn("text", F.xxhash64("text_embedding").cast("string"))
    rows_ = items.where("weight > 0 and product_id is not null").withColumn("text", F.xxhash64("text_embedding").cast("string"))

    def join(left, right, on):
        return left.join(right, on)

    bounded = tags.withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    for k in (None, 9):
        found = agg.max_score(best.best_of_texts(rows_, texts, bounded, ["category", "text"], floor="floor", k=k, join=join))
        wanted = plainly(rows_, tags, "floor")
        assert rows(top_k(found, k=k or 10_000)) == rows(top_k(wanted, k=k or 10_000))


def test_lengths_and_empty_sides(sides):
    items, tags = sides
    short = tags.withColumn("embedding", F.slice("embedding", 1, 5))
    with pytest.raises(Exception, match="differ in length"):
        best.best_pairs(items, short).collect()
    assert best.best_pairs(items, tags.where("false"), k=3).count() == 0
    assert best.best_pairs(items.where("false"), tags).count() == 0


def test_blocks_hold_whole_groups(spark, sides, monkeypatch):
    """Lists of 23 tags to a block: every row passes through one block, and what a task holds stays below two blocks' rows."""
    k, items, tags = 5, *sides
    monkeypatch.setattr(best, "HELD_ROWS", TAGS * k)
    blocks = best._blocks(similarity.prepared_tags(tags, "category", "embedding", None), "category", k)
    assert sorted((name, len(names)) for held, _ in blocks for name, (names, _, _) in held.value.items()) == [
        (g, TAGS) for g in "abd"] and len(blocks) == 3
    assert sum(items.where("category in ('a', 'b')").where(chosen).count() for _, chosen in blocks) == items.where(
        "category in ('a', 'b')").count()


def test_a_large_group_is_cut(spark, sides, monkeypatch):
    import pyarrow as pa

    cut = best._split({"a": (pa.array(list("vwxyz")), np.arange(10.0).reshape(2, 5), np.zeros(5)),
                       "b": (pa.array(["t"]), np.ones((2, 1)), np.ones(1))}, 2)
    assert [{g: names.to_pylist() for g, (names, _, _) in b.items()} for b in cut] == [
        {"a": ["v", "w"]}, {"a": ["x", "y"]}, {"a": ["z"], "b": ["t"]}]
    assert [b["a"][1].tolist() for b in cut] == [[[0, 1], [5, 6]], [[2, 3], [7, 8]], [[4], [9]]]
