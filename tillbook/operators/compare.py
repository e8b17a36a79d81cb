"""Comparison of products inside a category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import zero_if_null
from tillbook.operators.sales import units_by_product

# The rows of a comparison and their order.
COMPARED = [
    ("name", "product_name"),
    ("buy_price", "buy_price"),
    ("sell_price", "sell_price"),
    ("color", "color"),
    ("stock", "stock_qty"),
    ("units_sold", "units_sold"),
    ("revenue", "revenue"),
]


def active_categories(
    categories: DataFrame, products: DataFrame, sales: DataFrame
) -> DataFrame:
    """Categories with a product, where something was sold or is in stock."""
    totals = (
        products.filter(F.col("category_id").isNotNull())
        .select("product_id", "category_id", "stock_qty")
        .join(units_by_product(sales), "product_id", "left")
        .groupBy("category_id")
        .agg(F.sum("total_qty").alias("sold"), F.sum("stock_qty").alias("stock"))
        .filter((zero_if_null(F.col("sold")) > 0) | (zero_if_null(F.col("stock")) > 0))
    )
    return categories.join(totals, "category_id", "left_semi").select(
        "category_id", "category_name"
    )


def category_products(
    products: DataFrame, sales: DataFrame, category_id: int | None = None
) -> DataFrame:
    """Products of a category (of every category by default) with units and revenue.

    Only products that were sold or are in stock.
    """
    if category_id is None:
        chosen = products.filter(F.col("category_id").isNotNull())
    else:
        chosen = products.filter(F.col("category_id") == category_id)
    sold = sales.groupBy("product_id").agg(
        F.sum("qty").alias("units_sold"), F.sum("amount").alias("revenue")
    )
    return (
        chosen.join(sold, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category_id",
            "buy_price",
            "sell_price",
            "color",
            "producer_id",
            "sku",
            "description",
            "stock_qty",
            zero_if_null(F.col("units_sold")).alias("units_sold"),
            zero_if_null(F.col("revenue")).alias("revenue"),
        )
        .filter((F.col("units_sold") > 0) | (zero_if_null(F.col("stock_qty")) > 0))
    )


def category_best_worst(category_products: DataFrame) -> DataFrame:
    """Best and worst seller of each category; products never sold take part.

    Rows ``(category_id, kind, product_id, product_name, units_sold)``. Equal
    totals rank by product id.
    """
    entry = F.struct(
        "units_sold", (-F.col("product_id")).alias("rank_key"), "product_id", "product_name"
    )
    ends = category_products.groupBy("category_id").agg(
        F.max(entry).alias("best"), F.min(entry).alias("worst")
    )
    return ends.select(
        "category_id", F.expr("stack(2, 'best', best, 'worst', worst) as (kind, entry)")
    ).select(
        "category_id", "kind", "entry.product_id", "entry.product_name", "entry.units_sold"
    )


def compare_products(category_products: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two products side by side as parameter/value rows, values as text.

    ``pairs`` has ``pair_id, product_1, product_2``. A product that is not among
    ``category_products`` leaves its column NULL; a pair with neither has no rows.
    """
    values = F.struct(
        *[F.col(column).cast("string").alias(label) for label, column in COMPARED]
    )
    sheet = category_products.select("product_id", values.alias("sheet"))
    sides = pairs
    for side in ("product_1", "product_2"):
        sides = sides.join(
            sheet.withColumnsRenamed({"product_id": side, "sheet": f"{side}_sheet"}),
            side,
            "left",
        )
    rows = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(label).alias("parameter"),
                F.col(f"product_1_sheet.{label}").alias("product_1"),
                F.col(f"product_2_sheet.{label}").alias("product_2"),
            )
            for position, (label, _) in enumerate(COMPARED, start=1)
        ]
    )
    return (
        sides.filter(F.col("product_1_sheet").isNotNull() | F.col("product_2_sheet").isNotNull())
        .select("pair_id", F.inline(rows))
    )
