"""Picking the useful text out of a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trendloom.functions.expr import as_column, let, strip

FENCE, LANGUAGE = "```", "json"
_OUTPUT = "array<struct<type:string,content:array<struct<text:string>>>>"


def strip_code_fence(c: Column | str) -> Column:
    """Inside of the first fenced block, or the whole text where there is none."""

    def inside(parts: Column) -> Column:
        block = F.get(parts, F.lit(1))
        named = F.call_function("startswith", block, F.lit(LANGUAGE))
        return F.when(named, F.call_function("substring", block, F.lit(len(LANGUAGE) + 1))).otherwise(block)

    # before the first fence, inside of it, and all the rest
    return let(as_column(c), lambda x: let(F.split(x, FENCE, 3), lambda parts: strip(
        F.when(F.size(parts) == 3, inside(parts)).otherwise(x))))


def extract_answer_text(c: Column | str, index: int = 1, by_type: bool = False) -> Column:
    """Answer text of a response envelope: output item `index`, or the first message."""
    c = as_column(c)
    at_index = F.get_json_object(c, f"$.output[{index}].content[0].text")
    if not by_type:
        return at_index
    items = F.from_json(F.get_json_object(c, "$.output"), _OUTPUT)
    message = F.get(F.filter(items, lambda o: o["type"] == "message"), F.lit(0))
    return F.coalesce(at_index, F.get(message["content"], F.lit(0))["text"])
