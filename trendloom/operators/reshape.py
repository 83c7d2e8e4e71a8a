"""Unions and changes between long and wide form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.functions.expr import let, strip
from trendloom.functions.text import label_market
from trendloom.schemas import TREND


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column one side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def scores_to_wide(scores: DataFrame, tags: Sequence[str] | None = None, keys: Sequence[str] = ("product_id",),
                   score: str = "confidence", prefix: str = "sim_") -> DataFrame:
    """One column per tag, for export: all tags there are, or those named.

    Naming the tags spares a pass over the scores; a score of another tag is
    then an error, as it would have no column. Unnamed, more tags than Spark
    pivots by (`spark.sql.pivotMaxValues`) are refused.
    """
    if tags is None:
        most = int(scores.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        names = scores.select("tag").where("tag is not null").distinct().limit(most + 1).collect()
        if len(names) > most:
            raise ValueError(f"over {most} tags are too many columns; name those to export")
        tags = sorted(r["tag"] for r in names)
    else:
        stray = F.raise_error(F.concat(F.lit("no column is named for the tag "), F.col("tag")))
        scores = scores.withColumn("tag", F.when(F.col("tag").isNull() | F.col("tag").isin(list(tags)), F.col("tag"))
                                   .otherwise(stray))
    wide = scores.groupBy(*keys).pivot("tag", list(tags)).agg(F.max(score))
    return wide.withColumnsRenamed({t: f"{prefix}{t}" for t in tags})


def melt_scores(wide: DataFrame, keys: Sequence[str] = ("product_id",), prefix: str = "sim_",
                score: str = "confidence") -> DataFrame:
    """Back to one row per tag; only the leading prefix is taken off."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(list(keys), columns, "tag", score).where(F.col(score).isNotNull())
    return long.withColumn("tag", F.call_function("substring", F.col("tag"), F.lit(len(prefix) + 1)))


_LIST_FIELDS = [f.name for f in TREND.fields if f.dataType.typeName() == "array"]


def _markets(raw: DataFrame, json: str | Column) -> DataFrame:
    """One row per market of each file; a file that is no JSON object is one row without a market.

    The text is parsed here, once; what follows takes its parts out of the variant.
    """
    json = F.col(json) if isinstance(json, str) else json
    others = [c for c in raw.columns if c != "value"]
    parsed = raw.select(*others, json.alias("__file"), F.try_parse_json(json).alias("__parsed"))
    whole = parsed.select(*others, "__file", F.try_variant_get("__parsed", "$", "map<string,variant>").alias("__whole"))
    return whole.select(*others, "__file", F.col("__whole").isNotNull().alias("__object"),
                        F.explode_outer("__whole").alias("market_key", "__market"))


def _trends(markets: DataFrame) -> DataFrame:
    """One row per entry of each market, in order; a market that is no list is one row without an entry."""
    listed = markets.withColumn("__entries", F.try_variant_get("__market", "$", "array<variant>"))
    rows = listed.select(*markets.columns, F.col("__entries").isNotNull().alias("__listed"),
                         F.posexplode_outer("__entries").alias("trend_no", "__trend"))
    return rows.withColumn("__fields", F.try_variant_get("__trend", "$", "map<string,variant>"))


def _string_list(text: Column) -> Column:
    """A JSON list as it is; another text as a list of what stands between its commas."""
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
    return F.when(strip(text).startswith("["), F.from_json(text, "array<string>")).otherwise(parts)


def flatten_markets(raw: DataFrame, json: str | Column = "value") -> DataFrame:
    """One row per trend out of `{market key: [trend, ...]}`, markets and trends in order.

    Fields are brought to their types: numbers in quotes, and one text where a
    list belongs. Keys that a trend has besides are kept as text in `extra`.
    What cannot be a trend is in `market_rejects`; so is a file that names a
    key twice, as its variant could hold one of them only.
    """
    others = [c for c in raw.columns if c != "value"]
    rows = _trends(_markets(raw, json)).where("__fields is not null")

    def field(f) -> Column:
        text = F.try_variant_get("__trend", f"$.{f.name}", "string")
        if f.name in _LIST_FIELDS:
            listed = F.try_variant_get("__trend", f"$.{f.name}", "array<string>")
            return F.coalesce(listed, let(text, _string_list)).alias(f.name)
        return text.try_cast(f.dataType).alias(f.name)

    known = [f.name for f in TREND.fields]
    unknown = F.map_filter("__fields", lambda k, v: ~k.isin(known))
    extra = F.transform_values(unknown, lambda k, v: F.try_variant_get(v, "$", "string"))
    return rows.select(
        *others, label_market("market_key").alias("market"), "market_key", "trend_no",
        *[field(f) for f in TREND.fields], F.when(F.size(unknown) > 0, extra).alias("extra"))


def market_rejects(raw: DataFrame, json: str | Column = "value") -> DataFrame:
    """What `flatten_markets` leaves out: market_key, trend_no, reject_reason and the text that was refused.

    An empty list of trends, and a market of null, hold nothing to refuse.
    """
    others = [c for c in raw.columns if c != "value"]
    rows = _trends(_markets(raw, json))
    whole = F.col("market_key").isNull()
    # a market or trend of null is a variant that holds a null
    some = ~F.coalesce(F.is_variant_null("__market"), F.lit(True))
    reason = (F.when(whole, F.when(~F.col("__object"), "file is no object"))
              .when(some & ~F.col("__listed"), "market is no list")
              .when(F.col("trend_no").isNotNull() & F.col("__fields").isNull(), "trend is no object"))
    part = F.coalesce("__trend", "__market")
    text = F.when(whole, F.col("__file")).otherwise(
        F.coalesce(F.try_variant_get(part, "$", "string"), F.to_json(part)))
    return rows.select(*others, "market_key", "trend_no", reason.alias("reject_reason"), text.alias("refused")).where(
        "reject_reason is not null")
