"""Small arithmetic helpers that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def zero_null(c) -> Column:
    """Zero becomes NULL, so that a quotient by it is NULL and never raises."""
    return F.nullif(col(c), F.lit(0.0))


def safe_div(a, b) -> Column:
    return col(a) / zero_null(b)


def flag(condition: Column) -> Column:
    """Condition as 0 or 1, unknown counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sign_flag(positive: Column, negative: Column) -> Column:
    """+1, -1 or 0."""
    return F.when(positive, 1).when(negative, -1).otherwise(0)


def finite(c) -> Column:
    """The value if it is a finite number, else NULL."""
    value = col(c)
    return F.when(F.isnan(value) | F.abs(value).isin(float("inf")), None).otherwise(value)
