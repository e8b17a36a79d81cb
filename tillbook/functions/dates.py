"""Date columns: period starts, and the repair of dates that arrive as text or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day 0 of spreadsheet serial dates, and the last serial with a
# four-digit year (9999-12-31).
SERIAL_DAY_ZERO = "1899-12-30"
LAST_SERIAL = 2958465

_NUMBER = r"^\d{1,12}(\.\d+)?$"
_SECONDS = r"^-?\d{1,15}(\.\d+)?$"
_CALENDAR = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})([ T].*)?$"


def period_start(day: Column, period: str) -> Column:
    """First day of the week (Sunday), month or year that holds ``day``."""
    if period == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if period == "month":
        return F.trunc(day, "MM").cast("date")
    if period == "year":
        return F.trunc(day, "YYYY").cast("date")
    raise ValueError(f"period must be week, month or year, not {period!r}")


def _calendar_date(text: Column) -> Column:
    day = F.regexp_extract(text, _CALENDAR, 1)
    return F.try_to_date(F.translate(day, "/", "-"), "yyyy-M-d")


def normalize_date(value: Column) -> Column:
    """Spreadsheet serial, timestamp or ISO text to a date; NULL when it is none of them."""
    text = F.trim(value.cast("string"))
    serial = F.when(text.rlike(_NUMBER), F.floor(text.try_cast("double")))
    return (
        F.when(
            serial.isNotNull() & (serial <= LAST_SERIAL),
            F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), serial.try_cast("int")),
        )
        .when(serial.isNotNull(), F.lit(None).cast("date"))
        .otherwise(_calendar_date(text))
    )


def stored_date(df: DataFrame, name: str) -> Column:
    """A stored date column as a date: epoch seconds and ISO text are repaired.

    Seconds may be negative (before 1970) and lie as far off as Spark's dates reach.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    text = F.trim(F.col(name).cast("string"))
    if isinstance(kind, T.NumericType):
        seconds = F.floor(F.col(name))
    else:
        seconds = F.when(text.rlike(_SECONDS), F.floor(text.try_cast("double")))
    epoch_day = F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).try_cast("int")
    )
    return F.when(seconds.isNotNull(), epoch_day).otherwise(_calendar_date(text))
