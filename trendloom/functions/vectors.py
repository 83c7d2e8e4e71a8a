"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trendloom.functions.expr import as_column, drop_nan, let


# The last bits of a sum depend on the order of its terms, so on the kernel and
# on where a row lies in its batch. Scores are compared without them.
SCORE_DIGITS = 9


def stable(score: Column | str) -> Column:
    return F.round(as_column(score), SCORE_DIGITS)


def to_doubles(v: Column | str) -> Column:
    return as_column(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_column(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; the zero vector stays as it is."""
    v = as_column(v)
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))


def cosine_from_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine where each side's norm was worked out once per vector, not once per pair."""
    return F.coalesce(drop_nan(F.try_divide(dot(a, b), norm_a * norm_b)), F.lit(0.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of any two vectors; 0.0 where a side is missing or has no length."""
    a, b = as_column(a), as_column(b)
    return cosine_from_norms(a, b, norm(a), norm(b))


def weighted(score: Column | str, weight: Column | str) -> Column:
    return drop_nan(as_column(score) * as_column(weight))


def parse_vector(s: Column | str) -> Column:
    """Vector from its text form, with commas or blanks between the numbers."""
    body = F.btrim(as_column(s), F.lit("[] \t\r\n"))
    numbers = F.transform(F.split(body, r"[,\s]+"), lambda x: x.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)
