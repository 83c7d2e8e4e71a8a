"""Product descriptions out of attribute rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trendloom.operators.aggregates import distinct_values, ordered_concat
from trendloom.operators.sizing import row_partitions


def concat_description(df: DataFrame, key: str = "product_id",
                       type_: str = "standardize_type_updated", value: str = "normalised_name",
                       order_by: str | None = "pos", together: bool = False) -> DataFrame:
    """`<type> values are <v1, v2>. <type> values are ....` per product.

    Types and values stand in order of first appearance. Repeats collapse
    first; one shuffle by product then serves both remaining groupings and
    whatever is computed per product afterwards. With `together` the rows of a
    product lie in one task already, as in a bucketed table, and none is needed.
    """
    once = distinct_values(df, [key, type_], value, order_by)
    if not together:
        once = once.repartition(row_partitions(df), key)
    values = F.collect_list(F.struct("__pos", F.col(value).cast("string").alias("value")))
    per_type = once.groupBy(key, type_).agg(
        F.min("__pos").alias("__pos"), ordered_concat(values, ", ").alias("__list"))
    sentence = F.concat(F.col(type_), F.lit(" values are "), F.col("__list"))
    sentences = F.collect_list(F.struct("__pos", sentence.alias("value")))
    return per_type.groupBy(key).agg(
        F.concat(ordered_concat(sentences, ". "), F.lit(".")).alias("product_description"))
