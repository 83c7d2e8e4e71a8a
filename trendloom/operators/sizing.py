"""Joins to tables of any size, and work shared by equal keys.

Spark picks the join from the real sizes of its stages: a small side is
broadcast, the large partitions of a hot key are split. Only tables that a
kernel takes to the driver are measured before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DataType, MapType, NumericType, StringType,
                               StructType)

from trendloom.session import cut_lineage


_SALT = "__salt"


def _bytes_of(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, StructType):
        size = _sum_of([_bytes_of(c[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
        size = F.size(c) * 8
    elif isinstance(kind, ArrayType):
        size = F.aggregate(
            F.transform(c, lambda x: _bytes_of(x, kind.elementType)), F.lit(0).cast("long"),
            lambda total, x: total + x)
    elif isinstance(kind, MapType):
        size = F.octet_length(F.to_json(F.struct(c)))
    else:
        size = F.lit(8)
    return F.when(c.isNull(), F.lit(0)).otherwise(size).cast("long")


def _sum_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("long"))


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of `df`, from one aggregate that returns a single row."""
    per_row = _sum_of([_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(per_row).alias("bytes")).first()
    return row["rows"], row["bytes"] or 0


def _spread(df: DataFrame, salts: Column) -> Column:
    """Salt of a row. Copies of one row differ by the partition they sit in."""
    plain = [f.name for f in df.schema.fields
             if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return F.pmod(F.xxhash64(*[f"`{c}`" for c in plain], F.spark_partition_id()), salts).cast("int")


def _equal_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                null_safe: bool = False, hint_broadcast: bool = False) -> DataFrame:
    """Join on equal names; columns of the left first, then the others of the right."""
    if not null_safe:
        joined = left.join(F.broadcast(right) if hint_broadcast else right, list(on), how)
        return joined.select(*left.columns, *[c for c in right.columns if c not in on])
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    condition = reduce(
        lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__right_{c}`")) for c in on])
    joined = left.join(F.broadcast(renamed) if hint_broadcast else renamed, condition, how)
    return joined.drop(*[f"__right_{c}" for c in on])


def lookup_join(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                null_safe: bool = False, salts: int | None = None, fits: bool | None = None) -> DataFrame:
    """Join a fact table to a dimension.

    Spark broadcasts `small` if it turns out small, and splits hot keys
    otherwise. `fits` says that the caller has measured it to be small;
    `salts` copies it so many times and spreads each key of `df` over the
    copies, for a join whose output must stay partitioned as it is.
    """
    if salts is None or fits:
        return _equal_join(df, small, on, how, null_safe, hint_broadcast=bool(fits))
    salted = df.withColumn(_SALT, _spread(df, F.lit(salts)))
    copies = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _equal_join(salted, copies, [*on, _SALT], how, null_safe).drop(_SALT)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
              hot_rows: int | None = None) -> DataFrame:
    """Join two tables on a key that a large part of `left` may share.

    Spark splits what it finds skewed. With `hot_rows`, keys of more rows are
    counted first, which costs a pass over the keys; only those, at most rows
    / hot_rows of them, are salted on the left and copied on the right.
    """
    on = list(on)
    if hot_rows is None:
        return _equal_join(left, right, on, how)
    present = left.select(*on).na.drop()
    hot = cut_lineage(
        present.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts")))
    if hot.isEmpty():
        return _equal_join(left, right, on, how)
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    spread = lookup_join(left, hot, on)
    spread = spread.withColumn(_SALT, _spread(left, salts)).drop("__salts")
    copies = (lookup_join(right, hot, on)
              .withColumn(_SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts"))
    return _equal_join(spread, copies, [*on, _SALT], how).drop(_SALT)


def semi_by(df: DataFrame, keys_df: DataFrame, on: str) -> DataFrame:
    """Rows of `df` whose key occurs in `keys_df`; missing keys match nothing."""
    keys = keys_df.select(on).where(F.col(on).isNotNull()).distinct()
    return skew_join(df, keys, [on], "left_semi")


def work_partitions(df: DataFrame) -> int:
    """Tasks for work that costs CPU rather than bytes."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def row_partitions(df: DataFrame) -> int:
    """Tasks for a shuffle of rows that must not be merged into fewer."""
    return max(work_partitions(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_scan(df: DataFrame) -> DataFrame:
    """A scanned table spread over the cores, if it lies in too few pieces to use half of them.

    Tables of many splits stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(work_partitions(df)) if df.rdd.getNumPartitions() <= cores // 2 else df


def derive_once(df: DataFrame, keys: Sequence[str], derive: Callable[[DataFrame], DataFrame],
                partitions: int | None = None) -> DataFrame:
    """Add columns that depend on `keys` alone, worked out once per distinct key.

    `derive` gets the distinct keys and returns them with the new columns.
    What it returns is saved before it is joined back, so neither a lost
    executor nor a second use repeats the work. Rows with a missing key get
    no values.
    """
    distinct = df.select(*keys).na.drop().distinct()
    distinct = distinct.repartition(partitions or row_partitions(df), *keys)
    return skew_join(df, cut_lineage(derive(distinct)), keys)
