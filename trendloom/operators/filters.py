"""Row filters, column guards and small projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.functions import vocabulary as voc
from trendloom.functions.expr import drop_nan
from trendloom.functions.text import derive_gender
from trendloom.operators.joins import attach_threshold


def filter_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col("category") == category)


def filter_min_score(df: DataFrame, above: float = 0.0, score: str = "confidence") -> DataFrame:
    """Strictly above the bound; NaN counts as missing."""
    return df.where(drop_nan(F.col(score)) > above)


def filter_base_threshold(df: DataFrame, base: float | None = None) -> DataFrame:
    """Optional lower bound on the candidates, off unless given."""
    return df if base is None else filter_min_score(df, base)


def filter_category_threshold(df: DataFrame, thresholds: DataFrame | None,
                              score: str = "confidence", default: float = 0.0) -> DataFrame:
    """At or above the threshold of the row's category; without a table, all rows."""
    if thresholds is None:
        return df
    joined = attach_threshold(df, thresholds, default)
    return joined.where(F.col(score) >= F.col("threshold")).drop("threshold")


def unmatched_categories(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Categories in the data that no threshold is given for, with their row counts."""
    known = thresholds.select("category").distinct()
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("rows")).join(
        known, ["category"], "left_anti")


def filter_not_null(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def not_denied(denied: Sequence[str] = tuple(voc.DENIED_TAGS), tag: str = "tag") -> Column:
    """Whether a tag is none of those named, spelled with underscores or with blanks throughout."""
    spellings = [*denied, *[t.replace("_", " ") for t in denied]]
    return ~F.coalesce(F.col(tag).isin(spellings), F.lit(False))


def filter_denylist(df: DataFrame, denied: Sequence[str] = tuple(voc.DENIED_TAGS)) -> DataFrame:
    """Drop the named tags, spelled with underscores or with blanks throughout."""
    return df.where(not_denied(denied))


def filter_attribute_types(df: DataFrame,
                           allowed: Sequence[str] = tuple(voc.DESCRIPTION_TYPES)) -> DataFrame:
    return df.where(F.col("standardize_type_updated").isin(list(allowed)))


def default_confidence(df: DataFrame, column: str = "confidence") -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(1.0))


def add_missing_category(df: DataFrame, category: Column) -> DataFrame:
    return df if "category" in df.columns else df.withColumn("category", category)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def reorder_columns(df: DataFrame, first: Sequence[str] = ("category", "market")) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def stamp_validity(df: DataFrame, start_date: str, end_date: str) -> DataFrame:
    return df.withColumns({"start_date": F.lit(start_date).cast("date"),
                           "end_date": F.lit(end_date).cast("date")})


def with_gender(df: DataFrame) -> DataFrame:
    return df.withColumn("gender", derive_gender("category"))
