"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\r\n"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`.

    A lambda re-evaluates whatever outer expression it mentions for each
    array element; a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body).getItem(0)


def literal_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Trim any whitespace, not just blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def drop_nan(c: Column) -> Column:
    """NaN would win every max and pass every `>`; treat it as missing."""
    return F.nullif(c, F.lit(float("nan")))
