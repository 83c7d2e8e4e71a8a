"""Readers. Schemas are declared; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trendloom.functions.text import decoded_path, file_stem
from trendloom.functions.vectors import parse_vector
from trendloom.schemas import LEDGER, THRESHOLDS_CSV, TRENDS_CSV


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_trend_json(spark: SparkSession, folder: str) -> DataFrame:
    """(category, value): one row per file `<category>.json`, its whole text in `value`.

    What a name cannot hold is percent-encoded in it, as `write_trend_json` does.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = file_stem(decoded_path("_metadata.file_path"))
    return files.select(decoded_path(F.regexp_replace(name, r"%(?![0-9A-Fa-f]{2})", "%25")).alias("category"), "value")


def _csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of `schema`, found by the names in the header, wherever they stand.

    A missing column is an error, and so is a file whose header differs from that of the others.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = reader.csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no columns {missing}; there are {names}")
    kinds = {f.name: f for f in schema.fields}
    header = StructType([kinds.get(n, StructField(n, StringType())) for n in names])
    return reader.schema(header).option("enforceSchema", False).csv(path).select(*schema.names)


def read_trends_csv(spark: SparkSession, path: str, schema: StructType = TRENDS_CSV) -> DataFrame:
    """Trends as `write_trends_csv` writes them, or with TAGS_CSV processed ones; a vector in text form becomes an array."""
    trends = _csv(spark, path, schema)
    if "embedding" in trends.columns:
        trends = trends.withColumn("embedding", parse_vector("embedding"))
    return trends


def read_thresholds(spark: SparkSession, path: str) -> DataFrame | None:
    """(category, threshold); rows without a number are dropped, no file gives None."""
    try:
        rows = _csv(spark, path, THRESHOLDS_CSV)
    except AnalysisException as error:
        if path_missing(error):
            return None
        raise
    return clean_thresholds(rows)


def clean_thresholds(rows: DataFrame) -> DataFrame:
    table = rows.select("category", F.col("threshold").try_cast("double").alias("threshold")).where(
        F.col("threshold").isNotNull())
    repeated = table.groupBy("category").count().where("count > 1").select("category").take(1)
    if repeated:
        raise ValueError(f"more than one threshold for {repeated[0]['category']!r}")
    return table


def read_catalog(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """Parquet below `category=<name>` folders; the folder gives the category."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(root)


def read_category_dirs(spark: SparkSession, root: str) -> DataFrame:
    """Parquet files at any depth; the category is the first folder below `root`."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(root)
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    path = decoded_path("_metadata.file_path")
    inside = F.locate(base, path) > 0
    relative = F.when(inside, F.call_function("substring", path, F.locate(base, path) + F.lit(len(base)))).otherwise(
        F.raise_error(F.concat(path, F.lit(f" is not below {base}"))))
    category = F.when(relative.contains("/"), F.substring_index(relative, "/", 1)).otherwise("base_level")
    return rows.withColumn("category", F.regexp_replace(category, "^category=", ""))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name) of the files in a folder; their content is not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(folder))
    return files.select("path", F.substring_index(decoded_path("path"), "/", -1).alias("file_name"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Submitted batches; blank and malformed lines are skipped."""
    rows = spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("jsonl_file").isNotNull())
