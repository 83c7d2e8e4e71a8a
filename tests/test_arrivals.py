import pytest
from pyspark.sql import functions as F

from trendloom.functions.encoders import model_encoder
from trendloom.operators import aggregates as agg, filters
from trendloom.plans import matching
from trendloom.streaming import incremental

SCHEMA = "category string, embedding_text string, n int"


def state(spark, folder):
    return sorted(map(str, spark.read.parquet(str(folder)).collect()))


def test_known_texts_are_not_encoded_again(spark, tmp_path):
    src, out, vectors, log = (str(tmp_path / n) for n in ("src", "out", "vectors", "log"))
    calls = tmp_path / "calls"
    first = [("a", "red dress", 1), ("a", "red dress", 2), ("b", "blue top", 3), ("b", None, 4)]
    second = [("a", "red dress", 5), ("c", "green hat", 6), ("c", "", 7)]

    def model():
        import numpy as np

        def predict(texts):
            with open(calls, "a") as f:  # a worker that is used again counts on
                f.write("x" * len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return predict

    encoder = model_encoder(model)
    for number, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        incremental.embed_arrivals(spark, src, out, vectors, log, lambda df: df, encoder, spark.createDataFrame([], SCHEMA).schema)
        assert len(calls.read_text()) == (2, 4)[number]  # "red dress" is known by then
    got = {r.n: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[4].text_embedding is None
    assert got[1].text_embedding == got[5].text_embedding == pytest.approx([9 / 82 ** 0.5, 1 / 82 ** 0.5])
    assert {(r.n, r.arrival) for r in got.values()} == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1)}
    known = spark.read.parquet(vectors)
    assert known.count() == known.select("embedding_text").distinct().count() == 4

    # an arrival that is run again, whole or after it broke off, leaves the same tables
    before = state(spark, out), state(spark, vectors)
    write = incremental.arrival_writer(out, vectors, lambda df: df, encoder)
    write(spark.createDataFrame(second, SCHEMA), 1)
    assert (state(spark, out), state(spark, vectors)) == before and len(calls.read_text()) == 6
    # no new file, no arrival
    incremental.embed_arrivals(spark, src, out, vectors, log, lambda df: df, encoder, spark.createDataFrame([], SCHEMA).schema)
    assert (state(spark, out), state(spark, vectors)) == before and len(calls.read_text()) == 6


def test_filters_are_counted_by_the_run(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else i) for i in range(100)], "id int, x int")
    kept, seen = agg.observed_filters(rows, [("large", F.col("x") >= 50), ("even", F.col("x") % 2 == 0), ("all", F.lit(True))])
    kept.write.parquet(str(tmp_path / "kept"))
    assert [tuple(r.values()) for r in agg.filter_report(seen)] == [
        ("large", 100, 45, 55), ("even", 45, 20, 25), ("all", 20, 20, 0)]
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 20


@pytest.mark.parametrize("bounded", [True, False])
def test_thresholds_observed(spark, bounded):
    found = spark.createDataFrame([(i, "ab"[i % 2], ("fine", "co_ords")[i % 3 == 0], "india", "t", i / 20) for i in range(20)],
                                  "product_id int, category string, tag string, region string, tag_embedding_text string, confidence double")
    trends = spark.createDataFrame([("t", "india", "a", "told")], "tag_embedding_text string, region string, category string, description string")
    limits = spark.createDataFrame([("a", 0.5)], "category string, threshold double") if bounded else None
    kept, seen = matching.apply_thresholds_observed(found, limits, trends)
    plain = matching.apply_thresholds(found, limits, trends)
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.select(*kept.columns).collect()))
    report = agg.filter_report(seen)
    above = filters.filter_category_threshold(found, limits).count()
    assert [(r["rows_in"], r["rows_kept"]) for r in report] == [(20, above), (above, plain.count())]
