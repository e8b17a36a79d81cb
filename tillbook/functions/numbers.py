"""Numeric and blank-value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def is_blank(value: Column) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(value.cast("string") == "", F.lit(True))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` to two decimals; 0 where ``whole`` is not positive.

    Decimal arithmetic, so the digits do not depend on binary rounding. Tests
    against a threshold should compare ``part * 100`` with ``threshold * whole``.
    """
    exact = part.cast("decimal(20,0)") * 100 / F.when(whole > 0, whole.cast("decimal(20,0)"))
    return F.coalesce(F.round(exact, 2), F.lit(0)).cast("decimal(20,2)")


def whole_number(text: Column) -> Column:
    """Text as bigint; NULL when it is no whole number (``'7'`` and ``'7.0'`` are)."""
    value = text.try_cast("decimal(38,10)")
    return F.when(value == F.floor(value), value.try_cast("bigint"))
