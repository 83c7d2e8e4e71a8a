import uuid

import pytest
from pyspark.sql import functions as F

from trendloom.operators.describe import concat_description
from trendloom.operators.sizing import semi_by
from trendloom.plans import matching
from trendloom.sources import named_files, writers


def texts(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_named_files_replace_and_stay(spark, tmp_path):
    folder = tmp_path / "out"

    def write(*pairs, parts=3):
        named_files.write_named_files(spark.createDataFrame(list(pairs), "name string, value string").repartition(parts), str(folder), ".json")

    write(("a/b", "1"), ("é %", "2"), ("_hidden", "3"), (".too", "4"))
    assert texts(folder) == {"a%2Fb.json": "1\n", "é %25.json": "2\n", "%5Fhidden.json": "3\n", "%2Etoo.json": "4\n"}
    write(("a/b", "new"), ("c", ""))
    assert texts(folder) == {"a%2Fb.json": "new\n", "é %25.json": "2\n", "%5Fhidden.json": "3\n", "%2Etoo.json": "4\n", "c.json": "\n"}


def test_a_failed_task_leaves_the_old_files_whole(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(8).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("old").alias("value"))
    named_files.write_named_files(rows.repartition(4), str(folder))
    before = texts(folder)
    assert len(before) == 8
    broken = rows.repartition(8, "name").withColumn("value", F.when(
        F.col("name") == "n5", F.raise_error(F.lit("no text for n5")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="no text for n5"):
        named_files.write_named_files(broken, str(folder))
    assert texts(folder) == before  # nothing staged stays either
    for bad in ([("x", None)], [(None, "t")], [("", "t")], [("x", "1"), ("x", "2")]):
        with pytest.raises(Exception):
            named_files.write_named_files(spark.createDataFrame(bad, "name string, value string").repartition(2), str(folder))
        assert texts(folder) == before


def test_writer_by_itself(tmp_path):
    """Commit moves, abort forgets; a task that was run twice leaves nothing of its first attempt."""
    one = named_files.NamedFilesWriter(f"file://{tmp_path}/w", ".txt").begin()
    first, again = one.write(iter([("a", "1"), ("b", "2")])), one.write(iter([("a", "1"), ("b", "2")]))
    assert first.files != again.files
    one.commit([again, named_files.Written([]), None])
    assert texts(tmp_path / "w") == {"a.txt": "1\n", "b.txt": "2\n"}
    other = named_files.NamedFilesWriter(f"file:{tmp_path}/w", ".txt").begin()
    other.write(iter([("a", "other")]))
    other.abort([None])
    with pytest.raises(FileNotFoundError):  # a task that goes on after that
        other.write(iter([("b", "late")]))
    assert texts(tmp_path / "w") == {"a.txt": "1\n", "b.txt": "2\n"}


def test_columns_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="name and value"):
        named_files.write_named_files(spark.range(1), str(tmp_path / "x"))


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.range(4000).select(
        (F.col("id") % 300).alias("product_id"), F.lit("Women - Dresses").alias("category"),
        F.concat(F.lit("type "), (F.col("id") % 3).cast("string")).alias("standardize_type_updated"),
        F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("normalised_name"), F.col("id").alias("pos"))


def bucketed(spark, catalog, tmp_path, **options):
    name = f"t_{uuid.uuid4().hex}"
    return writers.write_bucketed(catalog, name, str(tmp_path / name), buckets=8, **options), spark.table(name)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_catalog_is_not_shuffled(spark, catalog, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done, table = bucketed(spark, catalog, tmp_path)
        assert done
        wanted = spark.range(100).select(F.col("id").alias("product_id"))
        assert shuffles(concat_description(table, together=True)) == 0
        # the keys' own shuffle, for their distinct values, is what is left
        assert shuffles(semi_by(table, wanted, "product_id")) == 1
        told = concat_description(semi_by(table, wanted, "product_id"), together=True)
        plain = concat_description(semi_by(catalog, wanted, "product_id"))
        assert shuffles(told) == 1 and shuffles(plain) >= 3
        assert sorted(map(tuple, told.collect())) == sorted(map(tuple, plain.collect()))
        vectors = told.select("product_id", F.array(F.lit(1.0)).alias("embeddings"))
        pairs = semi_by(table, wanted, "product_id").join(vectors, "product_id")
        assert shuffles(pairs) == 2  # of the keys, on either side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_of_a_bucketed_table(spark, catalog, tmp_path):
    done, table = bucketed(spark, catalog, tmp_path)
    assert done and table.count() == 4000
    files = table.select("product_id", F.input_file_name().alias("f")).distinct()
    assert files.count() == 300 and files.select("f").distinct().count() <= 8


def test_a_hot_key_is_not_put_in_one_bucket(spark, catalog, tmp_path):
    hot = catalog.withColumn("product_id", F.when(F.col("pos") % 3 == 0, 7).otherwise(F.col("product_id")))
    done, table = bucketed(spark, hot, tmp_path, hot_rows=1000)
    assert not done and table.count() == 4000
    told = matching.describe_products(table, hot, together=done)
    assert told.count() == matching.describe_products(hot, hot).count()
