"""Recommended actions: weak places, reorder, seasonal promotion, producer days, discounts.

Each action is computed from sales reduced to a small rollup. Called alone, an action
builds the rollup it needs; :func:`action_feed` reads the sales once and builds every
action from that one reading.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import percent, zero_if_null
from tillbook.operators.sales import revenue_per_place, units_by_product
from tillbook.plans.worktables import materialize

# Months that count as recent, and the percentages below which a producer
# gets a day and up to which a product counts as slow.
RECENT_MONTHS = 5
PRODUCER_SHARE_LIMIT = 40
SLOW_MOVER_SHARE = 10

# More than this many days in stock give this discount in percent.
DISCOUNT_STEPS = [(90, 20), (60, 10), (30, 5)]

# The type codes of the actions.
SPECIAL_DAY_PROMOTION = "special_day_promotion"
ZERO_SALES_CITIES = "zero_sales_cities"
LOWEST_STORE_SALES = "lowest_store_sales"
BEST_SELLING = "best_selling"
PRODUCER_DAY = "producer_day"
PRODUCT_DISCOUNT = "product_discount"

# Fixed value: special days that get the gift wording unless the caller names others.
GIFT_SEASONS = frozenset({"Communion"})


def recent_cut(as_of: dt.date, months: int = RECENT_MONTHS) -> dt.date:
    """First day of the month that lies ``months`` before the month of ``as_of``."""
    index = as_of.year * 12 + as_of.month - 1 - months
    return dt.date(index // 12, index % 12 + 1, 1)


def sales_rollup(sales: DataFrame, cut: dt.date) -> DataFrame:
    """Sales reduced to one row per product and place, in one pass."""
    recent = F.when(F.col("sold_on") >= F.lit(cut), F.col("qty"))
    return sales.groupBy("product_id", "place").agg(
        F.sum("amount").alias("total_sales"),
        F.sum("qty").alias("total_qty"),
        F.sum(recent).alias("recent_qty"),
    )


def product_units(products: DataFrame, by_product: DataFrame) -> DataFrame:
    """Every product with its totals, 0 where it was never sold.

    ``by_product`` has one row per product: ``product_id`` and any of ``total_qty`` and
    ``recent_qty``.
    """
    totals = [c for c in by_product.columns if c != "product_id"]
    return products.join(by_product, "product_id", "left").select(
        "product_id",
        "product_name",
        "producer_id",
        "stock_qty",
        "ordered_on",
        *[zero_if_null(F.col(c)).alias(c) for c in totals],
    )


def _zero_sales_places(by_place: DataFrame, places: DataFrame) -> DataFrame:
    return (
        places.select("place")
        .distinct()
        .join(by_place, "place", "left")
        .filter(zero_if_null(F.col("total_sales")) == 0)
        .groupBy()
        .agg(F.array_sort(F.collect_list("place")).alias("names"))
        .filter(F.size("names") > 0)
        .select(
            F.array_join("names", ", ").alias("places"),
            F.size("names").cast("bigint").alias("place_count"),
        )
    )


def zero_sales_places(sales: DataFrame, places: DataFrame) -> DataFrame:
    """One row naming the known places without revenue; empty when there are none.

    ``places`` is the caller's list of shops, so the joined text is as long as that list.
    """
    return _zero_sales_places(revenue_per_place(sales), places)


def _lowest_revenue_place(by_place: DataFrame) -> DataFrame:
    return by_place.orderBy(F.asc("total_sales"), F.asc("place")).limit(1)


def lowest_revenue_place(sales: DataFrame) -> DataFrame:
    """The place with the lowest revenue among places seen in sales."""
    return _lowest_revenue_place(revenue_per_place(sales))


def _reorder_best_seller(units: DataFrame) -> DataFrame:
    return (
        units.filter(F.col("total_qty") > 0)
        .select("product_id", "product_name", "total_qty", "stock_qty")
        .orderBy(F.desc("total_qty"), F.asc("product_id"))
        .limit(1)
    )


def reorder_best_seller(products: DataFrame, sales: DataFrame) -> DataFrame:
    """The product with the most units sold; empty when nothing was sold."""
    return _reorder_best_seller(product_units(products, units_by_product(sales)))


def next_special_day(
    special_days: DataFrame, as_of: dt.date, gift_seasons: Iterable[str] = GIFT_SEASONS
) -> DataFrame:
    """The earliest-starting special day that has not ended on ``as_of``."""
    first = F.min(F.struct("starts_on", "id", "name", "ends_on"))
    return (
        special_days.filter(F.col("ends_on") >= F.lit(as_of))
        .agg(first.alias("day"))
        .filter(F.col("day").isNotNull())
        .select(
            "day.id",
            "day.name",
            "day.starts_on",
            "day.ends_on",
            F.coalesce(F.col("day.name").isin(sorted(gift_seasons)), F.lit(False)).alias(
                "gift_season"
            ),
        )
    )


def _producer_days(units: DataFrame, producers: DataFrame, threshold: float) -> DataFrame:
    per_producer = (
        units.filter(F.col("producer_id").isNotNull())
        .groupBy("producer_id")
        .agg(F.sum("recent_qty").alias("recent_qty"), F.sum("total_qty").alias("total_qty"))
    )
    below = F.when(
        F.col("total_qty") > 0, F.col("recent_qty") * 100 < F.col("total_qty") * threshold
    ).otherwise(F.lit(0) < threshold)
    return (
        per_producer.filter(below)
        .join(producers, "producer_id")
        .select(
            "producer_id",
            "producer_name",
            "recent_qty",
            "total_qty",
            percent(F.col("recent_qty"), F.col("total_qty")).alias("recent_pct"),
        )
    )


def producer_days(
    producers: DataFrame,
    products: DataFrame,
    sales: DataFrame,
    as_of: dt.date,
    months: int = RECENT_MONTHS,
    threshold: float = PRODUCER_SHARE_LIMIT,
) -> DataFrame:
    """Producers with products whose recent share of units sold is below ``threshold`` percent.

    Recent means since the first of the month ``months`` before ``as_of``, with no
    upper bound. A producer that never sold anything has share 0.
    """
    recent = F.when(F.col("sold_on") >= F.lit(recent_cut(as_of, months)), F.col("qty"))
    by_product = sales.groupBy("product_id").agg(
        F.sum("qty").alias("total_qty"), F.sum(recent).alias("recent_qty")
    )
    return _producer_days(product_units(products, by_product), producers, threshold)


def _slow_mover_discounts(units: DataFrame, as_of: dt.date) -> DataFrame:
    youngest = as_of - dt.timedelta(days=min(days for days, _ in DISCOUNT_STEPS))
    opening = F.col("stock_qty") + F.col("total_qty")
    slow = (opening <= 0) | (F.col("total_qty") * 100 <= opening * SLOW_MOVER_SHARE)
    days_in_stock = F.date_diff(F.lit(as_of), F.col("ordered_on")).cast("bigint")
    discount = F.lit(None).cast("int")
    for days, step in reversed(DISCOUNT_STEPS):
        discount = F.when(days_in_stock > days, step).otherwise(discount)
    return (
        units.filter(F.col("ordered_on") < F.lit(youngest))
        .filter(F.col("stock_qty").isNotNull())
        .filter(slow)
        .select(
            "product_id",
            "product_name",
            days_in_stock.alias("days_in_stock"),
            "stock_qty",
            "total_qty",
            percent(F.col("total_qty"), opening).alias("sold_pct"),
            discount.alias("discount"),
        )
    )


def slow_mover_discounts(products: DataFrame, sales: DataFrame, as_of: dt.date) -> DataFrame:
    """Discount of 5, 10 or 20 percent for products that sold at most 10 percent.

    More than 30, 60 or 90 days in stock decide the step. Products without an order
    date or a stock figure get none.
    """
    return _slow_mover_discounts(product_units(products, units_by_product(sales)), as_of)


def _record(
    df: DataFrame,
    section: int,
    kind: str,
    tie_key: Column,
    *,
    id: Column,
    title: Column,
    description: Column,
    more_info: Column,
) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        tie_key.cast("bigint").alias("tie_key"),
        F.lit(kind).alias("type"),
        id.cast("string").alias("id"),
        title.alias("title"),
        description.alias("description"),
        more_info.alias("more_info"),
    )


@dataclass(frozen=True)
class DayTexts:
    """What the card of a special day advises: in a gift season, and else."""

    gift_offers: str = "Prepare gift offers."
    offers: str = "Prepare offers."
    gift_extras: str = "Consider discounts, free delivery or gift wrapping."
    extras: str = "Consider discounts, bundles or extras."


def _special_day_record(day: DataFrame, texts: DayTexts) -> DataFrame:
    gift, name = F.col("gift_season"), F.col("name")
    start = F.date_format("starts_on", "dd-MM-yyyy")
    end = F.date_format("ends_on", "dd-MM-yyyy")
    return _record(
        day,
        1,
        SPECIAL_DAY_PROMOTION,
        F.lit(0),
        id=F.col("id"),
        title=F.concat(F.when(gift, "Gift promotion for ").otherwise("Promotion for "), name),
        description=F.concat(
            name,
            F.when(gift, f" is near. {texts.gift_offers}").otherwise(f" is near. {texts.offers}"),
        ),
        more_info=F.concat(
            F.lit("Run the offers from "),
            start,
            F.lit(" to "),
            end,
            F.when(gift, f". {texts.gift_extras}").otherwise(f". {texts.extras}"),
        ),
    )


def _place_records(zero: DataFrame, lowest: DataFrame) -> DataFrame:
    zero_record = _record(
        zero,
        2,
        ZERO_SALES_CITIES,
        F.lit(0),
        id=F.lit("zero_sales"),
        title=F.lit("Places with no sales"),
        description=F.concat(F.lit("No revenue in: "), F.col("places")),
        more_info=F.lit("Consider discounts, marketing, or closing these places to save cost."),
    )
    place = F.coalesce("place", F.lit("(no place)"))
    lowest_record = _record(
        lowest.filter(~zero.exists()),
        2,
        LOWEST_STORE_SALES,
        F.lit(0),
        id=place,
        title=F.concat(F.lit("Place with the lowest sales: "), place),
        description=F.concat(
            F.lit("Total sales there: "), F.col("total_sales").cast("decimal(28,2)").cast("string")
        ),
        more_info=F.lit("Consider discounts, marketing or a campaign to raise sales there."),
    )
    return zero_record.unionByName(lowest_record)


def _reorder_record(best: DataFrame) -> DataFrame:
    return _record(
        best,
        3,
        BEST_SELLING,
        F.lit(0),
        id=F.col("product_id"),
        title=F.concat(F.lit("Order more of: "), F.col("product_name")),
        description=F.concat(
            F.lit("Best seller: "),
            F.col("product_name"),
            F.lit(" ("),
            F.col("total_qty").cast("string"),
            F.lit(" units sold)"),
        ),
        more_info=F.lit("Consider a larger order; customers buy this product most often."),
    )


def _producer_records(days: DataFrame) -> DataFrame:
    return _record(
        days,
        4,
        PRODUCER_DAY,
        F.col("producer_id"),
        id=F.col("producer_id"),
        title=F.concat(F.col("producer_name"), F.lit(" Day")),
        description=F.concat(
            F.lit("Recent sales of "),
            F.col("producer_name"),
            F.lit(" are only "),
            F.col("recent_pct").cast("string"),
            F.lit("% of all its sales."),
        ),
        more_info=F.concat(
            F.lit("Hold a "),
            F.col("producer_name"),
            F.lit(" Day: add accessories, run promotions or an event."),
        ),
    )


def _discount_records(discounts: DataFrame) -> DataFrame:
    step = F.col("discount").cast("string")
    return _record(
        discounts,
        5,
        PRODUCT_DISCOUNT,
        F.col("product_id"),
        id=F.col("product_id"),
        title=F.concat(F.lit("Discount for: "), F.col("product_name")),
        description=F.concat(
            F.col("days_in_stock").cast("string"),
            F.lit(" days in stock, only "),
            F.col("sold_pct").cast("string"),
            F.lit("% sold."),
        ),
        more_info=F.concat(F.lit("Lower the price by "), step, F.lit("%.")),
    )


def action_feed(
    products: DataFrame,
    producers: DataFrame,
    sales: DataFrame,
    special_days: DataFrame,
    places: DataFrame,
    as_of: dt.date,
    gift_seasons: Iterable[str] = GIFT_SEASONS,
    months: int = RECENT_MONTHS,
    threshold: float = PRODUCER_SHARE_LIMIT,
    texts: DayTexts = DayTexts(),
) -> DataFrame:
    """All actions as one list, ordered by ``(section, tie_key)``.

    Special day, then places without sales or else the weakest place, then the
    reorder, then producer days, then discounts. One row of type ``none`` when there
    is no action. Sales are read once, into a rollup, and products joined to it once.
    Both are written to the work folder, and so is the list before it is ordered:
    ordering reads its input twice.
    """
    rollup = materialize(sales_rollup(sales, recent_cut(as_of, months)), "sales-rollup")
    by_place = rollup.groupBy("place").agg(F.sum("total_sales").alias("total_sales"))
    by_product = rollup.groupBy("product_id").agg(
        F.sum("total_qty").alias("total_qty"), F.sum("recent_qty").alias("recent_qty")
    )
    units = materialize(product_units(products, by_product), "product-units")
    actions = (
        _special_day_record(next_special_day(special_days, as_of, gift_seasons), texts)
        .unionByName(
            _place_records(_zero_sales_places(by_place, places), _lowest_revenue_place(by_place))
        )
        .unionByName(_reorder_record(_reorder_best_seller(units)))
        .unionByName(_producer_records(_producer_days(units, producers, threshold)))
        .unionByName(_discount_records(_slow_mover_discounts(units, as_of)))
    )
    actions = materialize(actions, "actions")
    nothing = _record(
        products.sparkSession.range(1),
        6,
        "none",
        F.lit(0),
        id=F.lit("none"),
        title=F.lit("No current actions"),
        description=F.lit("There are no actions to show."),
        more_info=F.lit(""),
    ).filter(~actions.exists())
    return actions.unionByName(nothing).orderBy("section", "tie_key")
