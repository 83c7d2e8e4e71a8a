"""Aggregations over scores, attribute values and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from trendloom.functions.expr import drop_nan
from trendloom.functions.text import is_blank


def max_score(scores: DataFrame, keys: Sequence[str] = ("category", "product_id", "tag"),
              score: str = "score", out: str = "confidence") -> DataFrame:
    """Best score per key. NaN is no score, and rows without a key are left out."""
    for key in keys:
        scores = scores.where(F.col(key).isNotNull())
    return (scores.groupBy(*keys).agg(F.max(drop_nan(F.col(score))).alias(out)))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, order_by: str | None) -> DataFrame:
    """Each value of a key once, with the place it first appears at."""
    place = F.min(order_by) if order_by else F.lit(None).cast("long")
    for c in [*keys, value]:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*keys, value).agg(place.alias("__pos"))


def ordered_concat(pairs: Column, sep: str) -> Column:
    """Join the values of (position, value) structs in order of position."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["value"]), sep)


def concat_distinct(df: DataFrame, keys: Sequence[str], value: str, order_by: str | None = None,
                    sep: str = ", ", out: str = "values") -> DataFrame:
    """Distinct values per key in order of first appearance.

    Repeats collapse before the values of a key meet, so what meets is no
    longer than the text that comes out. Without `order_by`, order by value.
    """
    once = distinct_values(df, keys, value, order_by)
    pairs = F.collect_list(F.struct("__pos", F.col(value).cast("string").alias("value")))
    return once.groupBy(*keys).agg(ordered_concat(pairs, sep).alias(out))


def count_distinct_products(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("product_id").alias("products"))


def count_by_category(df: DataFrame) -> DataFrame:
    return (df.where(F.col("category").isNotNull()).groupBy("category")
            .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "category"))


def count_missing(df: DataFrame, column: str, out: str = "missing") -> DataFrame:
    return df.agg(F.count_if(is_blank(column)).alias(out))


def filter_audit(df: DataFrame, predicate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows in, kept and dropped by a filter."""
    passes = F.coalesce(predicate, F.lit(False))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(passes).alias("rows_kept"),
        F.count_if(~passes).alias("rows_dropped"))


def observed_filters(df: DataFrame, filters: Sequence[tuple[str, Column]],
                     name: str = "filters") -> tuple[DataFrame, Observation]:
    """Rows that pass all filters, one after the other, and their counts from the run that uses those rows.

    Nothing is scanned twice: the observation is filled by the first action
    on the result. Read it with `filter_report`, after that action. A filter
    that gives null drops the row.
    """
    seen, passes = Observation(name), F.lit(True)
    counts = [F.count(F.lit(1)).alias("rows_in")]
    for filter_name, predicate in filters:
        passes = passes & F.coalesce(predicate, F.lit(False))
        counts.append(F.count_if(passes).alias(filter_name))
    return df.observe(seen, *counts).where(passes), seen


def filter_report(seen: Observation) -> list[dict]:
    """filter, rows_in, rows_kept, rows_dropped of each filter in turn."""
    counts = list(seen.get.items())
    return [{"filter": name, "rows_in": before, "rows_kept": kept, "rows_dropped": before - kept}
            for (_, before), (name, kept) in zip(counts, counts[1:], strict=False)]


def mean_pool(df: DataFrame, key: Sequence[str], vec: str, dim: int | None = None, mask: str | None = None,
              eps: float = 1e-9, out: str = "embedding") -> DataFrame:
    """Masked mean of the vectors of each key; a null place counts as zero.

    Each Arrow batch sums its vectors by key, so what is shuffled is a sum per
    key and batch, however many rows a key has. A vector of another length
    than `dim`, or than the others of its key, is an error, wherever the two
    lie; keys may have vectors of lengths of their own.
    """
    rows = df.where(F.col(vec).isNotNull()).select(
        *key, F.col(vec).cast("array<double>").alias("__v"), (F.col(mask) if mask else F.lit(1.0)).cast("double").alias("__m"))
    schema = StructType([*[rows.schema[k] for k in key], StructField("__m", DoubleType()),
                         StructField("__s", ArrayType(DoubleType())), StructField("__n", IntegerType())])
    names = list(key)

    def partial_sums(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def of_one_length(whole):
            lengths = pc.list_value_length(whole.column("__v"))
            for size in pc.unique(lengths).to_pylist():
                if dim is not None and size != dim:
                    raise ValueError("vectors differ in length")
                yield size, whole.filter(pc.equal(lengths, size))

        for size, batch in (part for whole in batches for part in of_one_length(whole)):
            keys = pa.Table.from_batches([batch]).select(names).append_column(
                "__row", pa.array(np.arange(batch.num_rows)))
            firsts = keys.group_by(names).aggregate([("__row", "min")])["__row_min"].to_numpy() if names else np.zeros(1, np.int64)
            codes = np.zeros(batch.num_rows, np.int64)
            for name in names:
                part = batch.column(name).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (part.max() + 1) + part, return_inverse=True)[1]
            weights = batch.column("__m").fill_null(0.0).to_numpy(zero_copy_only=False)
            values = batch.column("__v").flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            sums = np.zeros((codes.max() + 1, size))
            np.add.at(sums, codes, values.reshape(batch.num_rows, size) * weights[:, None])
            total = np.bincount(codes, weights)
            order = codes[firsts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(pa.array(firsts)) for n in names), pa.array(total[order]),
                 pa.array(list(sums[order]), pa.list_(pa.float64())), pa.repeat(pa.scalar(size, pa.int32()), len(order))],
                names=[*names, "__m", "__s", "__n"])

    summed = rows.mapInArrow(partial_sums, schema)
    places = summed.select(*key, "__m", "__n", F.posexplode_outer("__s").alias("__place", "__x"))
    places = places.groupBy(*key, "__place").agg(
        F.sum("__m").alias("__m"), F.sum("__x").alias("__x"), F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    weight = F.greatest(F.col("__m"), F.lit(eps))
    pairs = F.array_sort(F.collect_list(F.when(
        F.col("__place").isNotNull(), F.struct("__place", (F.col("__x") / weight).alias("x")))))
    pooled = places.groupBy(*key).agg(pairs.alias("__p"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    differ = F.raise_error(F.lit("vectors of one key differ in length")).cast(pooled.schema["__p"].dataType)
    pooled = pooled.withColumn("__p", F.when(F.col("__lo") == F.col("__hi"), F.col("__p")).otherwise(differ))
    return pooled.select(*key, F.transform("__p", lambda p: p["x"]).alias(out))
