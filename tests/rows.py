"""Short ways to build the retail tables in tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tillbook.sources import schemas

PRODUCT = dict(
    product_id=1,
    product_name="lamp",
    category_id=1,
    buy_price=Decimal("1.00"),
    sell_price=Decimal("2.50"),
    color="red",
    producer_id=1,
    sku="S1",
    description="d",
    stock_qty=10,
    sold_qty=0,
    complaint_qty=0,
    ordered_on=dt.date(2024, 1, 1),
)
SALE = dict(
    sale_id="s1",
    sold_on=dt.date(2024, 1, 1),
    amount=Decimal("10.00"),
    product_id=1,
    place="North",
    qty=1,
)


def frame(spark, schema, rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def table(spark, schema, default, rows):
    names = schema.fieldNames()
    full = [{**default, **row} for row in rows]
    return frame(spark, schema, [[row[n] for n in names] for row in full])


def products(spark, *rows):
    return table(spark, schemas.PRODUCTS, PRODUCT, rows)


def sales(spark, *rows):
    numbered = [{"sale_id": f"s{i}", **row} for i, row in enumerate(rows)]
    return table(spark, schemas.SALES, SALE, numbered)


def categories(spark, *rows):
    return frame(spark, schemas.CATEGORIES, rows or [(1, "lights")])


def producers(spark, *rows):
    return frame(spark, schemas.PRODUCERS, rows or [(1, "Acme")])


def places(spark, *names):
    return frame(spark, schemas.PLACES, [(name, 1.0, 2.0) for name in names])


def raw_products(spark, *rows):
    default = dict(
        product_name="x",
        category_name="lights",
        buy_price="1",
        sell_price="2",
        color="red",
        producer_name="Acme",
        sku="k",
        description="d",
        stock_qty="3",
        ordered_on="2024-12-27",
    )
    return table(spark, schemas.RAW_PRODUCTS, default, rows)


def sale_requests(spark, *rows):
    default = dict(product_id=1, qty=1, place="North", sold_on=dt.date(2024, 1, 1))
    full = [{"request_id": f"r{i}", "seq": i, **row} for i, row in enumerate(rows, start=1)]
    return table(spark, schemas.SALE_REQUESTS, default, full)


def return_requests(spark, *rows):
    default = dict(sale_id="s0", qty=1, defective=False, description="back")
    full = [{"request_id": f"r{i}", "seq": i, **row} for i, row in enumerate(rows, start=1)]
    return table(spark, schemas.RETURN_REQUESTS, default, full)


def rows_of(df, *columns):
    """Rows as a list of tuples, in the order Spark gives them."""
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]


def sorted_rows(df, *columns):
    return sorted(rows_of(df, *columns), key=lambda row: tuple((v is None, str(v)) for v in row))
