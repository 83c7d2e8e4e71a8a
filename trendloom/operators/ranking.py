"""Top-k per group, first or last row per key, and ordering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.operators.sizing import row_partitions

_RANK = "__rank"
_SALT = "__salt"
_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _keep(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= k).drop(_RANK)


def top_k(df: DataFrame, by: Sequence[str] = ("tag", "category"), score: str = "confidence",
          k: int = 5000, tie: str | Sequence[str] = "product_id", salts: int | None = None) -> DataFrame:
    """The k best rows of each group; groups with a missing key are left out.

    A group is ranked in two rounds. Each task sends at most k rows of it,
    all to the task of the same salt; the winners of the salts meet in the
    second round. So with n tasks and about sqrt(n) salts no task sees more
    than sqrt(n) * k rows of a group, however large it is. Equal scores are
    ordered by `tie`.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    salts = salts or math.isqrt(row_partitions(df))
    # Spark cuts groups before a shuffle only up to this many rows
    conf = df.sparkSession.conf
    if int(conf.get(_LIMIT)) < k:
        conf.set(_LIMIT, str(k))
    for key in by:
        df = df.where(F.col(key).isNotNull())
    if salts > 1:
        df = df.withColumn(_SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
        df = _keep(df, [*by, _SALT], order, k).drop(_SALT)
    return _keep(df, by, order, k)


def first_last_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                       keep: str = "first") -> DataFrame:
    """One row per key: the first or the last one in the given order."""
    ascending = {"first": True, "last": False}[keep]
    order = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_first()
             for c in order_by]
    return _keep(df, keys, order, 1)


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return first_last_per_key(df, keys, order_by, "first")


def sort_mapping(df: DataFrame, score: str = "cosine_similarity",
                 tie: str = "product_id") -> DataFrame:
    """Presentation order; the ranking itself never needs a global sort."""
    return df.orderBy("tag", "category", F.col(score).desc_nulls_last(), tie)


def limit_files(files: DataFrame, n: int | None, path: str = "jsonl_file") -> DataFrame:
    """The first n files by name, or all of them."""
    return files.orderBy(path).limit(n) if n else files
