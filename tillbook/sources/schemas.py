"""One schema per stored table."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(**columns: str) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema.add(name, kind)
    return schema


MONEY = "decimal(18,2)"

PRODUCTS = _schema(
    product_id="long",
    product_name="string",
    category_id="long",
    buy_price=MONEY,
    sell_price=MONEY,
    color="string",
    producer_id="long",
    sku="string",
    description="string",
    stock_qty="long",
    sold_qty="long",
    complaint_qty="long",
    ordered_on="date",
)
CATEGORIES = _schema(
    category_id="long",
    category_name="string",
)
PRODUCERS = _schema(
    producer_id="long",
    producer_name="string",
)
SALES = _schema(
    sale_id="string",
    sold_on="date",
    amount=MONEY,
    product_id="long",
    place="string",
    qty="long",
)
RETURNS = _schema(
    return_id="string",
    product_id="long",
    defective="boolean",
    description="string",
)
SPECIAL_DAYS = _schema(
    id="long",
    name="string",
    starts_on="date",
    ends_on="date",
)

TABLES = {
    "products": PRODUCTS,
    "categories": CATEGORIES,
    "producers": PRODUCERS,
    "sales": SALES,
    "returns": RETURNS,
    "special_days": SPECIAL_DAYS,
}

PLACES = _schema(
    place="string",
    lat="double",
    lng="double",
)
SALE_REQUESTS = _schema(
    request_id="string",
    product_id="long",
    seq="long",
    qty="long",
    place="string",
    sold_on="date",
)
RETURN_REQUESTS = _schema(
    request_id="string",
    sale_id="string",
    seq="long",
    qty="long",
    defective="boolean",
    description="string",
)

# Attributes a caller may set on a product; the counters are kept by the ledger.
PRODUCT_ATTRIBUTES = [
    "product_name",
    "category_id",
    "buy_price",
    "sell_price",
    "color",
    "producer_id",
    "sku",
    "description",
    "stock_qty",
    "ordered_on",
]

# Columns an intake file must have. All are text until intake has read them.
RAW_PRODUCT_COLUMNS = [
    "product_name",
    "category_name",
    "buy_price",
    "sell_price",
    "color",
    "producer_name",
    "sku",
    "description",
    "stock_qty",
    "ordered_on",
]
RAW_PRODUCTS = _schema(**dict.fromkeys(RAW_PRODUCT_COLUMNS, "string"))
