"""Prompts, batch requests, answers and the ledger of submitted batches."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.functions import vocabulary as voc
from trendloom.functions.answers import extract_answer_text, strip_code_fence
from trendloom.functions.expr import as_column, let, strip
from trendloom.operators.sizing import lookup_join

# A short template; a caller passes their own. Fields in braces name columns.
PROMPT = """You are a fashion trend analyst for a large online shop.
List 10-15 distinct, search-friendly trend hashtags for the category: {category}
For each trend give trend_name, primary_hashtag, supporting_hashtags (3-5),
aesthetic_description, confidence (0.0 to 5.0), region (India or Global),
common_product_types and best_use_in_ecommerce.
Answer with JSON of this form:
{{"trending_tags_india": [...], "trending_tags_global": [...]}}
"""


def render_prompts(categories: DataFrame, template: str = PROMPT) -> DataFrame:
    """One prompt per category. Doubled braces in the template are literal ones."""
    pieces: list[Column] = []
    for text, field, _, _ in Formatter().parse(template):
        pieces.append(F.lit(text))
        if field:
            pieces.append(F.col(field))
    return categories.select("category", F.concat(*pieces).alias("prompt"))


def build_request(custom_id: Column | str, text: Column | str, model: Column | str,
                  image_base64: Column | str | None = None) -> Column:
    """One request as JSON text; with an image, the content is a list of parts."""
    custom_id, text, model = as_column(custom_id), as_column(text), as_column(model)

    def request(content: Column) -> Column:
        message = F.struct(F.lit("user").alias("role"), content.alias("content"))
        return F.to_json(F.struct(
            custom_id.cast("string").alias("custom_id"),
            F.lit("POST").alias("method"),
            F.lit("/chat/completions").alias("url"),
            F.struct(model.alias("model"), F.array(message).alias("messages"),
                     F.lit(1000).alias("max_tokens")).alias("body")))

    if image_base64 is None:
        return request(text)
    image = as_column(image_base64)
    nothing = F.lit(None).cast("string")
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                 F.struct(nothing.alias("url")).alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), nothing.alias("text"),
                 F.struct(F.concat(F.lit("data:image/jpeg;base64,"), image).alias("url")).alias("image_url")))
    # a null struct is left out of the JSON, an empty one is not
    parts = F.transform(parts, lambda p: F.struct(
        p["type"].alias("type"), p["text"].alias("text"),
        F.when(p["image_url"]["url"].isNotNull(), p["image_url"]).alias("image_url")))
    return F.when(image.isNull(), request(text)).otherwise(request(parts))


def parse_answers(df: DataFrame, response: str = "response", index: int = 1,
                  by_type: bool = False) -> DataFrame:
    """Add `trends_json` and, where there is none, the reason in `reject_reason`.

    Fences are taken off the envelope and off the text inside it, unless it
    is JSON as it stands.
    """

    def valid(c: Column) -> Column:
        return F.try_parse_json(c).isNotNull()

    def unfenced(c: Column) -> Column:
        return let(c, lambda x: F.when(valid(x), x).otherwise(strip_code_fence(x)))

    def result(trends: Column | None, reason: Column | str | None) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct((F.lit(None) if trends is None else trends).cast("string").alias("trends_json"),
                        reason.cast("string").alias("reject_reason"))

    def of_text(text: Column) -> Column:
        return (F.when(text.isNull(), result(None, "no answer text"))
                .when(valid(text), result(text, None)).otherwise(result(text, "invalid answer")))

    def of_envelope(envelope: Column) -> Column:
        text = unfenced(extract_answer_text(envelope, index, by_type))
        return F.when(valid(envelope), let(text, of_text)).otherwise(result(None, "invalid envelope"))

    raw = F.col(response)
    parsed = F.when(raw.isNull() | (strip(raw) == ""), result(None, "no response")).otherwise(
        let(unfenced(raw), of_envelope))
    return df.withColumn("__parsed", parsed).select(*df.columns, "__parsed.*")


def split_valid_json(df: DataFrame, response: str = "response", index: int = 1,
                     by_type: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers that parse, and the rejected ones with a reason."""
    parsed = parse_answers(df, response, index, by_type)
    good = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = parsed.where(F.col("reject_reason").isNotNull()).drop("trends_json")
    return good, rejects


def batch_state(ledger: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """State of each submitted batch.

    `status(id, status)` holds what was last heard of a batch and wins over
    what the ledger recorded at submission.
    """
    rows = ledger.select("jsonl_file", F.col("batch.id").alias("id"),
                         F.col("batch.status").alias("logged"))
    if status is not None:
        rows = lookup_join(rows, status.select("id", F.col("status").alias("current")), ["id"])
    else:
        rows = rows.withColumn("current", F.lit(None).cast("string"))
    now = F.coalesce("current", "logged")
    return rows.select("jsonl_file", "id", now.alias("status"), classify_status(now).alias("state"))


def classify_status(status: Column | str) -> Column:
    status = as_column(status)
    return (F.when(status.isin(voc.BATCH_ACTIVE), "active").when(status.isin(voc.BATCH_DONE), "done")
            .when(status.isin(voc.BATCH_ENDED), "ended").otherwise("unknown"))


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("batches"))
