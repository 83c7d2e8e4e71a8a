import pytest
from pyspark.sql import functions as F

from trendloom.plans import matching
from trendloom.sources.together import read_together, write_together


def values(tables):
    return {name: sorted(map(tuple, df.collect())) for name, df in tables.items()}


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "pair")
    assert read_together(spark, root) == {}
    rows = spark.range(3)
    write_together(spark, {"a": rows, "b": lambda done: done["a"].select((F.col("id") * 2).alias("twice"))}, root)
    first = read_together(spark, root)
    old = {"a": [(0,), (1,), (2,)], "b": [(0,), (2,), (4,)]}
    assert values(first) == old

    broken = rows.select(F.when(F.col("id") == 2, F.raise_error(F.lit("no row 2")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no row 2"):
        write_together(spark, {"a": rows.where("id > 5"), "b": broken}, root)
    assert values(read_together(spark, root)) == old  # the first table of the failed run is not seen

    write_together(spark, {"a": rows.where("id = 1"), "c": rows.limit(0)}, root + "/")
    assert values(read_together(spark, root)) == {"a": [(1,)], "c": []}
    assert values(first) == old  # a reader that started before goes on with its run
    with pytest.raises(ValueError, match="needs a table"):
        write_together(spark, {}, root)


def test_later_tables_agree_with_written_ones(spark, tmp_path):
    # numbers that differ each time the plan runs
    rows = spark.range(50, numPartitions=4).select(F.expr("uuid()").alias("key"))
    write_together(spark, {"rows": rows, "keys": lambda done: done["rows"].select("key").distinct()}, str(tmp_path))
    now = read_together(spark, str(tmp_path))
    assert now["rows"].join(now["keys"], "key").count() == 50


def test_mapping_and_tags(spark, tmp_path):
    trends = spark.createDataFrame(
        [("red dress", "W", "us", [1.0], "red_dress"), ("hat", "W", "us", [2.0], "hat"), (None, None, None, None, None)],
        "preprocessed_tag string, category string, region string, embedding array<double>, tag string")
    mapping = spark.createDataFrame([(1, "red_dress"), (2, "hat"), (3, None)], "product_id int, tag string")
    for kept, tags in (("product_id > 0", {"red dress", "hat"}), ("product_id = 2", {"hat"}), ("product_id > 2", set())):
        matching.publish_together(mapping.where(kept), trends, str(tmp_path))
        now = read_together(spark, str(tmp_path))
        assert {r.tag_value for r in now["tags"].collect()} == tags
        assert now["mapping"].count() == mapping.where(kept).count()
