"""Joins between candidates, tags, thresholds and product vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trendloom.operators.ranking import first_last_per_key
from trendloom.operators.sizing import lookup_join, semi_by

__all__ = [
    "semi_by", "tags_in_output", "attach_product_vector", "attach_tag_meta", "attach_threshold",
    "attach_description", "attach_tag_vector", "lookup_tag_vector", "global_tag_vectors", "tag_meta",
    "entry_per_key", "pending",
]


def entry_per_key(trends: DataFrame, keys: Sequence[str], columns: Sequence[str],
                  order_by: Sequence[str], keep: str = "first") -> DataFrame:
    """(keys, columns) of the first or last trend per key; the order may include keys."""
    rows = trends.select(*dict.fromkeys([*keys, *columns, *order_by]))
    return first_last_per_key(rows, keys, order_by, keep).select(*keys, *columns)


def tags_in_output(tag_dim: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tag rows whose tag occurs in the mapping."""
    return semi_by(tag_dim, mapping.select("tag"), "tag")


def attach_product_vector(candidates: DataFrame, vectors: DataFrame,
                          column: str = "embeddings") -> DataFrame:
    """Candidates that have a product vector, with it. One vector per product."""
    known = vectors.where(F.col(column).isNotNull() & F.col("product_id").isNotNull())
    return candidates.join(known, ["product_id"], "inner")


def tag_meta(trends: DataFrame, order_by: Sequence[str] = ("pos",)) -> DataFrame:
    """Region and text of each tag per category: those of its first entry there."""
    keys = ["category", "tag"]
    return entry_per_key(trends.na.drop(subset=keys), keys, ["region", "tag_embedding_text"], order_by)


def attach_tag_meta(scores: DataFrame, trends: DataFrame, order_by: Sequence[str] = ("pos",)) -> DataFrame:
    """Region and text of the tag in the row's own category; its first entry counts."""
    return lookup_join(scores, tag_meta(trends, order_by), ["category", "tag"])


def attach_threshold(df: DataFrame, thresholds: DataFrame, default: float = 0.0) -> DataFrame:
    """Threshold of the category, or the default. One row per category is expected."""
    joined = lookup_join(df, thresholds.select("category", "threshold"), ["category"])
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(default)))


def attach_description(df: DataFrame, trends: DataFrame) -> DataFrame:
    """Description by text, region and category; missing keys match missing keys."""
    keys = ["tag_embedding_text", "region", "category"]
    return lookup_join(df, trends.select(*keys, "description"), keys, null_safe=True)


def attach_tag_vector(trends: DataFrame, vectors: DataFrame,
                      on: Sequence[str] = ("tag", "tag_embedding_text")) -> DataFrame:
    """Vectors of the distinct (tag, text) pairs back on all tag rows."""
    return lookup_join(trends, vectors, list(on))


def lookup_tag_vector(df: DataFrame, trends: DataFrame, order_by: Sequence[str] = ("pos",),
                      vector: str = "embedding") -> DataFrame:
    """Vector of the tag whatever its category; its last entry counts, none gives null."""
    known = trends.where(F.col("tag").isNotNull())
    return lookup_join(df, entry_per_key(known, ["tag"], [vector], order_by, "last"), ["tag"])


def global_tag_vectors(trends: DataFrame, order_by: Sequence[str] = ("pos",),
                       vector: str = "embedding") -> DataFrame:
    """One vector per tag over all categories: that of its first entry."""
    return entry_per_key(trends.where(F.col("tag").isNotNull()), ["tag"], [vector], order_by)


def pending(inputs: DataFrame, done: DataFrame, on: str = "file_name") -> DataFrame:
    """Inputs that are not among the finished ones."""
    return inputs.join(done.select(on).where(F.col(on).isNotNull()).distinct(), [on], "left_anti")
