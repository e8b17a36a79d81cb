"""Row-level listings: products, stock, sales and returns with names joined in.

No join carries a broadcast hint: Spark broadcasts a lookup table when its size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise. Products that
sales and returns look names up in are shuffled from a number of rows on (``lookup``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import lookup, stored_date


def product_list(products: DataFrame) -> DataFrame:
    """Id, name, sell price and stock of every product."""
    return products.select("product_id", "product_name", "sell_price", "stock_qty")


def product_details(
    products: DataFrame,
    categories: DataFrame,
    producers: DataFrame,
    ids: Iterable[int] | DataFrame | None = None,
    how: str = "inner",
) -> DataFrame:
    """Products with category and producer names and a repaired order date.

    ``how='inner'`` drops products whose category or producer is unknown;
    ``how='left'`` keeps them with a NULL name. ``ids`` picks products by id, from a
    short list or from a DataFrame with a ``product_id`` column.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    if isinstance(ids, DataFrame):
        products = products.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    elif ids is not None:
        products = products.filter(F.col("product_id").isin(list(ids)))
    return (
        products.join(categories, "category_id", how)
        .join(producers, "producer_id", how)
        .select(
            "product_id",
            "product_name",
            "buy_price",
            "sell_price",
            "color",
            "producer_id",
            "sku",
            "description",
            "stock_qty",
            "sold_qty",
            "complaint_qty",
            stored_date(products, "ordered_on").alias("ordered_on"),
            "category_name",
            "producer_name",
        )
    )


def in_stock(products: DataFrame, categories: DataFrame, producers: DataFrame) -> DataFrame:
    """Products on hand whose category and producer are known."""
    return (
        products.filter(F.col("stock_qty") > 0)
        .join(categories, "category_id")
        .join(producers, "producer_id")
        .select(
            "product_id",
            "product_name",
            "sell_price",
            "stock_qty",
            "color",
            "category_name",
            "producer_name",
        )
    )


def sales_list(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sales with the product name; sales of unknown products are left out."""
    names = lookup(products.select("product_id", "product_name"))
    return sales.join(names, "product_id").select(
        "sale_id", "product_id", "product_name", "sold_on", "amount", "place", "qty"
    )


def returns_list(returns: DataFrame, products: DataFrame) -> DataFrame:
    """Returns with the product name and the defect flag as yes/no; NULL reads no."""
    names = lookup(products.select("product_id", "product_name"))
    return returns.join(names, "product_id").select(
        "return_id",
        "product_id",
        "product_name",
        F.when(F.col("defective"), "yes").otherwise("no").alias("defective"),
        "description",
    )
