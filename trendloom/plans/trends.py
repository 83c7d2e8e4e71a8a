"""From model answers to the table of trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trendloom.functions.encoders import Encoder
from trendloom.functions.expr import strip
from trendloom.functions.text import normalize_tag
from trendloom.operators.corpus import encode_distinct
from trendloom.operators.filters import reorder_columns
from trendloom.operators.joins import attach_tag_vector
from trendloom.operators.requests import split_valid_json
from trendloom.operators.reshape import flatten_markets, market_rejects
from trendloom.sources.readers import read_trend_json
from trendloom.sources.writers import write_trend_json, write_trends_csv


def curate_trends(answers: DataFrame, folder: str, index: int = 1, by_type: bool = False) -> DataFrame:
    """Write the JSON of each category that answered; return the rejected answers.

    `answers(category, response)` is one row per category.
    """
    good, rejects = split_valid_json(answers, index=index, by_type=by_type)
    write_trend_json(good, folder)
    return rejects


def trend_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of a folder hold that is no trend, with the reason."""
    return market_rejects(read_trend_json(spark, folder))


def flat_trends(spark: SparkSession, folder: str) -> DataFrame:
    """One row per trend of all files of a folder."""
    return reorder_columns(flatten_markets(read_trend_json(spark, folder)))


def consolidate_trends(spark: SparkSession, folder: str, csv_path: str) -> DataFrame:
    """Write all trends of a folder into one CSV table and return them."""
    trends = flat_trends(spark, folder)
    write_trends_csv(trends.drop("market_key", "trend_no"), csv_path)
    return trends


def canonicalize_trends(flat: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Tag, texts and, with an encoder, vectors for the flat trends.

    The region is the one that the trend names; the market it stands under
    counts only where it names none. Trends keep their order as (category,
    market_key, trend_no).
    """
    tag = F.replace(F.lower(strip(F.col("trend_name"))), F.lit(" "), F.lit("_"))
    trends = (
        flat.withColumn("tag", tag)
        .withColumn("region", F.lower(F.coalesce(F.nullif(strip(F.col("region")), F.lit("")), "market")))
        .withColumnRenamed("aesthetic_description", "description")
        .withColumn("preprocessed_tag", normalize_tag("tag"))
        .withColumn("tag_embedding_text", F.col("preprocessed_tag")))
    return trends if encoder is None else embed_trends(trends, encoder)


def embed_trends(trends: DataFrame, encoder: Encoder) -> DataFrame:
    """Vectors of the tag texts, each distinct text encoded once."""
    vectors = encode_distinct(trends, "tag_embedding_text", encoder, "embedding")
    pairs = trends.select("tag", "tag_embedding_text").distinct().join(vectors, ["tag_embedding_text"])
    return attach_tag_vector(trends, pairs)


def tag_dimension(trends: DataFrame) -> DataFrame:
    """Tag rows under the names of the published table, and the tag by which the mapping knows them."""
    return trends.select(
        F.col("preprocessed_tag").alias("tag_value"), "category",
        F.col("region").alias("tag_type"), F.col("embedding").alias("vector"), "tag")
