"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType

from trendloom.session import cut_lineage
from trendloom.sources.named_files import write_named_files


def write_partitioned(df: DataFrame, root: str, by: str = "category", rebalance: bool = True) -> None:
    """Parquet per category; only categories present in `df` are replaced.

    Rebalancing keeps each task from writing a small file per category and
    splits a category that is much larger than the others.
    """
    rows = df.hint("rebalance", by) if rebalance else df
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(root))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_trends_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array and map columns as JSON text."""
    arrays = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType))}
    (df.withColumns(arrays).write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(path))


def write_trend_json(df: DataFrame, folder: str, json: str = "trends_json") -> None:
    """A file `<category>.json` per row, with its JSON text as it came.

    Files of other categories stay. A category that occurs twice, or is null or
    empty, is refused before anything is written. Tasks write the files; they
    get their names once all are written, so a run that fails changes nothing.
    Characters that a file name cannot hold are percent-encoded.
    """
    rows = cut_lineage(df.select(F.col("category").cast("string").alias("name"), F.col(json).cast("string").alias("value")),
                       "trend-json")
    bad = rows.groupBy("name").count().where("count > 1 or name is null or name = ''").select("name").take(1)
    if bad:
        raise ValueError(f"one row per category is expected; there are more, or no name, for {bad[0]['name']!r}")
    write_named_files(rows, folder, ".json")


def write_bucketed(df: DataFrame, table: str, path: str, by: str = "product_id", buckets: int = 64,
                   hot_rows: int = 1 << 20) -> bool:
    """A table whose rows lie together by `by`, so that joins and groups on it need no shuffle of the table.

    One task writes each bucket, in order of the key. A key of over `hot_rows`
    rows would make a bucket that one task has to read; then the table is
    written without buckets, False is returned, and joins shuffle, where Spark
    splits such a key.
    """
    hot = not df.groupBy(by).count().where(F.col("count") > hot_rows).isEmpty()
    rows = df if hot else df.repartition(buckets, by)
    writer = rows.write.mode("overwrite").option("path", path)
    if not hot:
        writer = writer.bucketBy(buckets, by).sortBy(by)
    writer.saveAsTable(table)
    return not hot


def write_requests(df: DataFrame, path: str, request: str | Column = "request") -> None:
    """JSON lines, one request each."""
    request = F.col(request) if isinstance(request, str) else request
    df.select(request.alias("value")).write.mode("overwrite").text(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.select("jsonl_file", "batch").write.mode("append").json(path)
