"""Helpers shared by the operators."""

from tillbook.functions.dates import normalize_date, period_start, stored_date
from tillbook.functions.joins import lookup
from tillbook.functions.numbers import (
    is_blank,
    percent,
    whole_number,
    zero_if_null,
)

__all__ = [
    "is_blank",
    "lookup",
    "normalize_date",
    "percent",
    "period_start",
    "stored_date",
    "whole_number",
    "zero_if_null",
]
