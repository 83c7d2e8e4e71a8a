"""Trends, catalogs and answers derived from the sample tables, all rows of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trendloom.functions import vocabulary as voc
from trendloom.functions.encoders import hash_encoder, model_encoder, token_encoder
from trendloom.functions.expr import literal_array
from trendloom.functions.text import normalize_tag
from trendloom.functions.vectors import l2_normalize
from trendloom.operators.aggregates import mean_pool
from trendloom.operators.sizing import spread_scan
from trendloom.sources.readers import clean_thresholds

DIM = 64
ENCODER = hash_encoder(DIM)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.get(literal_array(values), index.cast("int"))


def region_of(n: Column) -> Column:
    return F.when(n % 5 == 0, F.lit(None)).when(n % 2 == 0, "india").otherwise("global")


def threshold_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(voc.THRESHOLDS, "category string, threshold string, status string")


def thresholds(spark: SparkSession) -> DataFrame:
    return clean_thresholds(threshold_rows(spark))


def _hash_model():
    """The sums of `hash_encoder` in numpy, not brought to unit length."""
    import hashlib

    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), DIM), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.split():
                digest = hashlib.md5(word.encode()).hexdigest()
                row[int(digest[:4], 16) % DIM] += 1 - 2 * (int(digest[4], 16) % 2)
        return out

    return predict


MODEL = model_encoder(_hash_model)


def _word_lengths():
    """A tokenizer whose token of a word is the word's length."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    return lambda texts: [[len(w) for w in word.findall(t)] for t in texts]


def _length_model():
    """Counts of the ids by their remainder by eight."""
    import numpy as np

    return lambda ids, mask: np.stack([((ids % 8 == k) & (mask > 0)).sum(axis=1) for k in range(8)], axis=1)


TOKEN_MODEL = token_encoder(_word_lengths, _length_model, max_tokens=None)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with vectors: three rows per product, one weight in ten is zero."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.floor(F.col("vec_id") / 3).cast("long").alias("product_id"),
        pick(voc.CATEGORIES, F.col("label") + 4).alias("category"),
        ((F.col("vec_id") * 7 % 10) / 10.0).alias("confidence"),
        F.col("embedding").alias("text_embedding"))


def tag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(((F.col("label") * 5) + F.col("vec_id") % 5).cast("long").alias("pos"), "label",
                    "vec_id", "embedding")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends with vectors: centroids of the vectors, five per label.

    Tags recur across categories and within one, regions and descriptions
    are partly missing.
    """
    pooled = mean_pool(tag_groups(spark, sf_dir), ["pos", "label"], "embedding")
    n = F.col("pos")
    number = F.when(n % 10 == 3, n - 1).otherwise(n % 40)
    tag = F.concat(F.lit("tag_"), number.cast("string"))
    return pooled.select(
        "pos", tag.alias("tag"), pick(voc.CATEGORIES, F.col("label") + 4).alias("category"),
        region_of(n).alias("region"), F.concat(F.lit("text "), n.cast("string")).alias("tag_embedding_text"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 7 == 1, "  ")
        .otherwise(F.concat(F.lit("about "), tag)).alias("description"),
        l2_normalize("embedding").alias("embedding"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight attribute rows per part, one of them without a value at times."""
    part = spread_scan(table(spark, sf_dir, "part"))
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    sleeve = (F.when(size % 4 == 0, "Sleeveless").when(size % 4 == 1, "Half Sleeve")
              .when(size % 4 == 2, "3rd Sleeves & Cuffs"))
    pattern = F.concat(pick([p for p, _ in voc.PHRASES], key % 45), F.lit(" and"))
    occasion = F.concat((size % 12).cast("string"), F.lit(" piece "), name, F.lit(" Dresses, 80s_wear"))
    attributes = [
        ("brand", F.col("p_brand")), ("style", F.col("p_type")),
        ("color", F.split_part(name, F.lit(" "), F.lit(1))), ("product title", name),
        ("size", size.cast("string")), ("sleeve length", sleeve), ("pattern", pattern),
        ("occasion", occasion),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).cast("long").alias("pos"), F.lit(t).alias("standardize_type_updated"),
                 v.alias("normalised_name"))
        for i, (t, v) in enumerate(attributes, 1)])
    out = part.select(key.alias("product_id"), pick(voc.CATEGORIES, key % 16).alias("category"),
                      F.inline(rows))
    weight = ((F.col("product_id") * 7 + F.col("pos")) % 11 - 1) / 10.0
    return out.withColumn("confidence", weight)


def part_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends named like the parts, one entry per part name and brand."""
    part = table(spark, sf_dir, "part")
    groups = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("pos"))
    n = F.col("pos")
    tag = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    text = normalize_tag(tag)
    return groups.select(
        n, tag.alias("tag"), pick(voc.CATEGORIES, n % 16).alias("category"),
        region_of(n).alias("region"), text.alias("preprocessed_tag"), text.alias("tag_embedding_text"),
        F.concat(F.lit("about "), F.col("p_brand")).alias("description"),
        ENCODER(text).alias("embedding"))


def repeated_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows out of the line items, with values that repeat a lot."""
    li = table(spark, sf_dir, "lineitem")
    rows = F.array(
        F.struct(F.lit("occasion").alias("standardize_type_updated"), F.col("l_returnflag").alias("normalised_name")),
        F.struct(F.lit("lining").alias("standardize_type_updated"), F.col("l_linestatus").alias("normalised_name")))
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")
    return li.select(F.col("l_partkey").alias("product_id"), pos, F.inline(rows))


def _envelope(inner: Column) -> Column:
    message = F.struct(F.lit("message").alias("type"),
                       F.array(F.struct(inner.alias("text"))).alias("content"))
    thinking = F.struct(F.lit("reasoning").alias("type"),
                        F.array(F.struct(F.lit(None).cast("string").alias("text"))).alias("content"))
    return F.to_json(F.struct(F.array(thinking, message).alias("output")))


def _response(envelope: Column, which: Column) -> Column:
    """Fenced, plain or broken."""
    return (F.when(which % 3 == 0, F.concat(F.lit("```json\n"), envelope, F.lit("\n```")))
            .when(which % 3 == 1, envelope).otherwise(F.concat(F.lit("{"), envelope)))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers around the turns of the conversations: fenced, plain, broken, missing."""
    turns = table(spark, sf_dir, "conversations")
    inner = F.to_json(F.struct(F.col("turn").alias("t"), F.col("text")))
    response = F.when(F.col("turn") % 4 != 3, _response(_envelope(inner), F.col("conv_id")))
    return turns.select("conv_id", "turn", response.alias("response"))


def trend_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers whose inside is a trend file, some fenced within, some broken."""
    files = trend_files(spark, sf_dir)
    which = F.length("category")
    inner = F.when(which % 2 == 0, F.concat(F.lit("```\n"), "value", F.lit("\n```"))).otherwise(F.col("value"))
    return files.select("category", _response(_envelope(inner), which).alias("response"))


def trend_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, value): trend files as JSON text, one per part name, a trend per brand."""
    part = table(spark, sf_dir, "part")
    brands = part.groupBy("p_name", "p_brand").agg(
        F.min("p_partkey").alias("n"), F.max("p_retailprice").alias("price"))
    trend = F.struct(
        F.concat(F.col("p_brand"), F.lit(" Look")).alias("trend_name"),
        F.concat(F.lit("#"), F.col("p_brand")).alias("primary_hashtag"),
        F.array(F.lit("#a"), F.concat(F.lit("#b, \"c\" "), F.col("p_brand"))).alias("supporting_hashtags"),
        F.concat(F.lit("about "), F.col("p_name"), F.lit(",\n\"quoted\"")).alias("aesthetic_description"),
        F.col("price").alias("confidence"))
    entry = F.struct("n", trend.alias("trend"))
    files = brands.groupBy("p_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") % 2 == 0, entry))).alias("india"),
        F.array_sort(F.collect_list(F.when(F.col("n") % 2 == 1, entry))).alias("global"))
    value = F.to_json(F.struct(
        F.transform("india", lambda e: e["trend"]).alias("trending_tags_india"),
        F.transform("global", lambda e: e["trend"]).alias("trending_tags_global")))
    category = F.concat(F.col("p_name"), F.lit(" & 50%+ off"))
    return files.select(category.alias("category"), value.alias("value"))


def messy_trend_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`trend_files` as models write them: by the length of the category's name, one of six defects or none."""
    value, which = F.col("value"), F.length("category") % 7
    number, tags = r'"confidence":([0-9.E]+)', r'"supporting_hashtags":\[[^\]]*\]'
    messy = (F.when(which == 0, F.expr("left(value, length(value) - 3)"))
             .when(which == 1, F.concat(F.lit('{"notes":"see below",'), F.expr("substring(value, 2)")))
             .when(which == 2, F.replace(value, F.lit('"confidence":'), F.lit('"mood":"high","confidence":')))
             .when(which == 3, F.regexp_replace(value, number, '"confidence":"$1"'))
             .when(which == 4, F.regexp_replace(value, tags, '"supporting_hashtags":"#x, #y"'))
             .when(which == 5, F.replace(value, F.lit("[{"), F.lit('["oops",{'))).otherwise(value))
    return trend_files(spark, sf_dir).select("category", messy.alias("value"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submitted batch per event."""
    statuses = {"signup": "validating", "view": "in_progress", "click": "completed",
                "error": "failed", "purchase": "expired"}
    status = F.col("event_type")
    for event, name in statuses.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    files = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    batch = F.struct(
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("id"), status.alias("status"),
        F.lit(None).cast("string").alias("output_file_id"), F.lit(None).cast("string").alias("error_file_id"))
    return table(spark, sf_dir, "events").select(files.alias("jsonl_file"), batch.alias("batch"))


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was last heard of the batches that have an order of the same number."""
    status = (F.when(F.col("o_orderstatus") == "F", "completed")
              .when(F.col("o_orderstatus") == "O", "finalizing").otherwise("cancelled"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"), status.alias("status"))
