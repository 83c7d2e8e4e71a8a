"""Declared schemas of all files the library reads."""

from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


TREND = StructType([
    *_strings("trend_name", "primary_hashtag"),
    StructField("supporting_hashtags", ArrayType(StringType())),
    *_strings("aesthetic_description"),
    StructField("confidence", DoubleType()),
    *_strings("region"),
    StructField("common_product_types", ArrayType(StringType())),
    *_strings("best_use_in_ecommerce"),
])
TREND_FILE = StructType([
    StructField("trending_tags_india", ArrayType(TREND)),
    StructField("trending_tags_global", ArrayType(TREND)),
])
TRENDS_CSV = StructType([
    *_strings("category", "market", "trend_name", "primary_hashtag", "supporting_hashtags",
              "aesthetic_description", "confidence", "region", "common_product_types",
              "best_use_in_ecommerce"),
])
TAGS_CSV = StructType([
    *_strings("tag", "category", "region", "description", "preprocessed_tag",
              "tag_embedding_text", "embedding"),
])
THRESHOLDS_CSV = StructType(_strings("category", "threshold"))
LEDGER = StructType([
    *_strings("jsonl_file"),
    StructField("batch", StructType(_strings("id", "status", "output_file_id", "error_file_id"))),
])
