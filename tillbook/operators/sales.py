"""Sales reports.

Sales are reduced to one row per product or place before anything is joined to them:
the shuffle then carries partial sums, and a product or place that holds a large share
of all sales costs no more than any other. Margin by period is the exception: products
and periods together are nearly as many as sales, so it joins first and sums by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import lookup, period_start, zero_if_null


def units_by_product(sales: DataFrame) -> DataFrame:
    """Units sold per product; NULL where every quantity is NULL."""
    return sales.groupBy("product_id").agg(F.sum("qty").alias("total_qty"))


def revenue_per_place(sales: DataFrame) -> DataFrame:
    """Revenue per place; a NULL place is a place of its own."""
    return sales.groupBy("place").agg(F.sum("amount").alias("total_sales"))


def margin_by_period(sales: DataFrame, products: DataFrame, period: str) -> DataFrame:
    """Margin at current prices per week (from Sunday), month or year.

    Sales without a date form a period of their own; a period whose quantities are
    all NULL has margin 0.
    """
    unit_margin = products.select(
        "product_id", (F.col("sell_price") - F.col("buy_price")).alias("unit_margin")
    )
    return (
        sales.join(lookup(unit_margin), "product_id")
        .groupBy(period_start(F.col("sold_on"), period).alias("period"))
        .agg(zero_if_null(F.sum(F.col("unit_margin") * F.col("qty"))).alias("total_margin"))
    )


def best_and_worst(sales: DataFrame, products: DataFrame) -> DataFrame:
    """First and last product by units sold, among products with at least one sale.

    Rows ``(kind, product_id, product_name, total_qty)``. Equal totals rank by
    product id; a NULL total ranks last.
    """
    ranked = units_by_product(sales).join(
        lookup(products.select("product_id", "product_name")), "product_id"
    )
    entry = F.struct(
        "total_qty", (-F.col("product_id")).alias("rank_key"), "product_id", "product_name"
    )
    ends = ranked.agg(F.max(entry).alias("best"), F.min(entry).alias("worst"))
    return ends.select(F.expr("stack(2, 'best', best, 'worst', worst) as (kind, entry)")).filter(
        F.col("entry").isNotNull()
    ).select("kind", "entry.product_id", "entry.product_name", "entry.total_qty")


def total_units_sold(sales: DataFrame) -> DataFrame:
    """Units over all sales, known product or not; NULL when there are none."""
    return sales.agg(F.sum("qty").alias("total_units"))


def total_stock(products: DataFrame) -> DataFrame:
    """Units on hand over all products; NULL when there are none."""
    return products.agg(F.sum("stock_qty").alias("total_stock"))


def units_by_mapped_place(sales: DataFrame, places: DataFrame) -> DataFrame:
    """Units and marker radius per place of the map; nothing when there are no sales."""
    units = sales.groupBy("place").agg(F.sum("qty").alias("total_qty"))
    return (
        places.join(units, "place", "left")
        .filter(sales.exists())
        .withColumn("total_qty", zero_if_null(F.col("total_qty")))
        .select(
            "place", "lat", "lng", "total_qty", (F.sqrt("total_qty") * 2).alias("radius")
        )
    )


def _units_by_name(
    sales: DataFrame, products: DataFrame, names: DataFrame, id_col: str, name_col: str
) -> DataFrame:
    return (
        units_by_product(sales)
        .join(lookup(products.select("product_id", id_col)), "product_id")
        .join(names, id_col)
        .groupBy(name_col)
        .agg(F.sum("total_qty").alias("total_qty"))
        .orderBy(F.desc("total_qty"), name_col)
    )


def units_by_producer(sales: DataFrame, products: DataFrame, producers: DataFrame) -> DataFrame:
    """Units per producer name, highest first; producers of one name count as one."""
    return _units_by_name(sales, products, producers, "producer_id", "producer_name")


def units_by_category(sales: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Units per category name, highest first; categories of one name count as one."""
    return _units_by_name(sales, products, categories, "category_id", "category_name")


def revenue_by_place(sales: DataFrame) -> DataFrame:
    """Revenue per place, highest first."""
    return revenue_per_place(sales).orderBy(F.desc("total_sales"), "place")
