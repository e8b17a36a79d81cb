"""Bulk intake of product rows: column check, name lookup, date repair, quality rules."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tillbook.functions import is_blank, normalize_date, whole_number
from tillbook.plans.worktables import materialize
from tillbook.sources.schemas import MONEY, PRODUCT_ATTRIBUTES, RAW_PRODUCT_COLUMNS

# The order dates the template allows.
FIRST_ORDER_DATE = "2000-01-01"
LAST_ORDER_DATE = "2100-12-31"


class Intake(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def require_columns(raw: DataFrame) -> None:
    """Raise unless every column of the intake layout is there; others are ignored."""
    missing = [name for name in RAW_PRODUCT_COLUMNS if name not in raw.columns]
    if missing:
        raise ValueError(
            f"missing columns: {', '.join(missing)}; expected: {', '.join(RAW_PRODUCT_COLUMNS)}"
        )


def domain_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column``."""
    return df.select(column).distinct()


def resolve_names(raw: DataFrame, dim: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Add ``id_col`` by name. An unknown name keeps its row, with a NULL id.

    A name that ``dim`` holds twice would multiply rows, so it stops the job.
    """
    held = F.col(f"{id_col}_held")
    return (
        _named(raw, dim, name_col, id_col)
        .withColumn(id_col, F.when(held > 1, _held_twice(name_col)).otherwise(F.col(id_col)))
        .drop(f"{id_col}_held")
    )


def _named(raw: DataFrame, dim: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Add ``id_col`` by name, and how many rows of ``dim`` hold that name."""
    lookup = (
        dim.filter(F.col(name_col).isNotNull())
        .groupBy(name_col)
        .agg(F.min(id_col).alias(id_col), F.count("*").alias(f"{id_col}_held"))
    )
    return raw.join(lookup, name_col, "left")


def _held_twice(name_col: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{name_col} is not unique: "), F.col(name_col)))


def _read_rows(raw: DataFrame, categories: DataFrame, producers: DataFrame) -> DataFrame:
    """Raw columns kept as they are, typed values beside them, and a reject reason.

    Every reader of the reason also looks the names up, so that refused rows cannot be
    published while a name is held twice.
    """
    named = _named(raw, categories, "category_name", "category_id")
    named = _named(named, producers, "producer_name", "producer_id")
    typed = {
        "buy_price": F.col("buy_price").cast("string").try_cast(MONEY),
        "sell_price": F.col("sell_price").cast("string").try_cast(MONEY),
        "stock_qty": whole_number(F.col("stock_qty").cast("string")),
        "ordered_on": normalize_date(F.col("ordered_on")),
    }

    def unreadable(name: str) -> Column:
        return ~is_blank(F.col(name)) & F.col(f"typed.{name}").isNull()

    reason = (
        F.when(F.col("category_id_held") > 1, _held_twice("category_name"))
        .when(F.col("producer_id_held") > 1, _held_twice("producer_name"))
        .when(is_blank(F.col("product_name")), "missing_name")
        .when(unreadable("ordered_on"), "bad_date")
    )
    for name in ("buy_price", "sell_price", "stock_qty"):
        reason = reason.when(unreadable(name), f"bad_{name}")
    return named.withColumn(
        "typed", F.struct(*[value.alias(name) for name, value in typed.items()])
    ).withColumn("reason", reason)


def import_products(raw: DataFrame, categories: DataFrame, producers: DataFrame) -> Intake:
    """Split intake rows into product rows to add and rows refused with a reason.

    Refused: rows without a name, and rows whose date, price or stock is text that
    cannot be read as one. Unknown categories and producers stay, with a NULL id.
    """
    require_columns(raw)
    rows = _read_rows(raw.select(*RAW_PRODUCT_COLUMNS), categories, producers)
    return _split(rows)


def _split(rows: DataFrame) -> Intake:
    read = ("buy_price", "sell_price", "stock_qty", "ordered_on")
    accepted = rows.filter(F.col("reason").isNull()).select(
        *[F.col(f"typed.{c}").alias(c) if c in read else F.col(c) for c in PRODUCT_ATTRIBUTES]
    )
    rejected = rows.filter(F.col("reason").isNotNull()).select(*RAW_PRODUCT_COLUMNS, "reason")
    return Intake(accepted, rejected)


class CheckedIntake(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    broken: dict[str, int]


def import_and_check(
    raw: DataFrame,
    categories: DataFrame,
    producers: DataFrame,
    rules: Mapping[str, Column] | None = None,
) -> CheckedIntake:
    """``import_products``, and by rule how many rows break it, in one pass over ``raw``.

    The rows are written once with their reasons; the counts are observed while they are,
    behind the joins, in the tasks that write: those count once, also when they are retried.
    Accepted and rejected rows are read from what was written. A rule nobody breaks has 0.
    """
    require_columns(raw)
    rules = template_rules() if rules is None else rules
    rows = _read_rows(raw.select(*RAW_PRODUCT_COLUMNS), categories, producers)
    listed = rows.withColumn("category_listed", F.col("category_id_held").isNotNull())
    listed = listed.withColumn("producer_listed", F.col("producer_id_held").isNotNull())
    seen = Observation()
    counts = [F.count_if(broken).alias(rule) for rule, broken in rules.items()]
    written = materialize(listed.observe(seen, *counts), "intake")
    return CheckedIntake(*_split(written), {rule: seen.get[rule] for rule in rules})


def template_rules() -> dict[str, Column]:
    """Rule name → condition that breaks it, for the columns of an intake row.

    Besides the raw columns, a condition may use ``category_listed`` and
    ``producer_listed``. Blank cells break no rule.
    """

    def not_whole(name: str) -> Column:
        value = F.col(name).cast("string").try_cast("decimal(38,10)")
        return ~is_blank(F.col(name)) & (
            value.isNull() | (value != F.floor(value)) | (value < 0)
        )

    day = normalize_date(F.col("ordered_on"))
    in_range = F.coalesce(
        day.between(F.lit(FIRST_ORDER_DATE).cast("date"), F.lit(LAST_ORDER_DATE).cast("date")),
        F.lit(False),
    )
    return {
        "category_not_listed": ~is_blank(F.col("category_name")) & ~F.col("category_listed"),
        "producer_not_listed": ~is_blank(F.col("producer_name")) & ~F.col("producer_listed"),
        "buy_price_not_whole": not_whole("buy_price"),
        "sell_price_not_whole": not_whole("sell_price"),
        "stock_qty_not_whole": not_whole("stock_qty"),
        "ordered_on_out_of_range": ~is_blank(F.col("ordered_on")) & ~in_range,
    }


def check_intake(
    raw: DataFrame,
    categories: DataFrame,
    producers: DataFrame,
    key: str = "sku",
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row ``(row_key, rule)`` per broken rule; the template's rules by default."""
    require_columns(raw)
    rules = template_rules() if rules is None else rules
    listed = raw
    for dim, column in ((categories, "category_name"), (producers, "producer_name")):
        flag = f"{column.removesuffix('_name')}_listed"
        values = domain_values(dim, column).withColumn(flag, F.lit(True))
        listed = listed.join(values, column, "left").withColumn(
            flag, F.coalesce(flag, F.lit(False))
        )
    broken = F.array_compact(
        F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()])
    )
    return listed.select(F.col(key).alias("row_key"), F.explode(broken).alias("rule"))


def count_violations(violations: DataFrame) -> DataFrame:
    """Broken rules counted by rule."""
    return violations.groupBy("rule").agg(F.count("*").alias("row_count"))
