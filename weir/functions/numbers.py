"""Column helpers for numbers that arrive as text or with unusable values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(col: Column) -> Column:
    """Number or NULL: unreadable, NaN and infinite values become NULL."""
    num = col.try_cast("double")
    return F.when(F.abs(num) < F.lit(float("inf")), num)        # NaN sorts above infinity


def cents(col: Column) -> Column:
    """An amount in whole cents.  Sums of these are exact, whatever order tasks finish in."""
    return F.rint(col * 100).cast("long")


def total_amount(col: Column) -> Column:
    """Sum of a money column from exact cents, as an aggregate."""
    return F.sum(cents(col)) / 100


def mean_amount(col: Column) -> Column:
    """Mean of a money column from its exact sum, as an aggregate."""
    return F.sum(cents(col)) / F.count(col) / 100


def first_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The number captured by ``pattern``, or NULL."""
    return F.regexp_extract(text, pattern, group).try_cast("double")

