"""Stock ledger: batches of sales and returns applied to a stock snapshot.

Both operators judge every request once, write the verdicts to the work folder, and
derive all their results from them. Verdicts on returns hold the sales asked for, so that
only the full table of sales has to meet them again. They return new frames; write those to a new
directory, never over the one being read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import is_blank, zero_if_null
from tillbook.operators.grants import BLOCK_ROWS, FOLD_LIMIT, UNASKED, grant_in_order
from tillbook.plans.worktables import materialize

ORDER = ("seq", "request_id")


class SalesApplied(NamedTuple):
    products: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    changed_products: DataFrame
    """Only the product rows that differ: what a store has to write."""


class ReturnsApplied(NamedTuple):
    products: DataFrame
    sales: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    changed_products: DataFrame
    changed_sales: DataFrame
    """Only the sales whose quantity fell, without those that went."""
    removed_sales: DataFrame
    """Ids of the sales that a return took to 0."""
    touched_sales: DataFrame
    """Sales changed or removed, as they were before."""


def apply_sales(
    products: DataFrame,
    requests: DataFrame,
    as_of: dt.date,
    order: Sequence[str] = ORDER,
    fold_limit: int = FOLD_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> SalesApplied:
    """Sell from stock, each request all or nothing against the stock then left.

    ``requests`` has ``request_id, product_id, seq, qty, place, sold_on``; requests of a
    product are served in ``order``, equal places in it by id. Accepted requests come back as sales rows (``sale_id`` is the request id, ``amount`` the current price
    times the quantity), refused ones with the first reason that applies: missing_field,
    bad_qty, future_date, duplicate_request, unknown_product, insufficient_stock. Of
    several sound requests with one id the first in order counts, then the one of the
    smallest other columns. A missing request id is a missing field. An unknown place is no
    reason. A product sold out stays, with stock 0. A product id that is asked for and
    held twice stops the job.
    """
    reason = (
        F.when(
            F.col("request_id").isNull()
            | F.col("qty").isNull()
            | is_blank(F.col("place"))
            | F.col("sold_on").isNull(),
            "missing_field",
        )
        .when(F.col("qty") < 1, "bad_qty")
        .when(F.col("sold_on") > F.lit(as_of), "future_date")
    )
    supply = products.select(
        "product_id", "sell_price", zero_if_null(F.col("stock_qty")).alias("opening")
    )
    verdicts = grant_in_order(
        requests.withColumn("reason", reason),
        supply,
        "product_id",
        unknown="unknown_product",
        too_much="insufficient_stock",
        order=order,
        fold_limit=fold_limit,
        block_rows=block_rows,
        unique="request_id",
        repeated="duplicate_request",
    )
    granted = verdicts.filter(F.col("reason").isNull())
    accepted = granted.select(
        F.col("request_id").alias("sale_id"),
        "sold_on",
        (F.col("sell_price") * F.col("qty")).cast("decimal(18,2)").alias("amount"),
        "product_id",
        "place",
        "qty",
    )
    sold = granted.groupBy("product_id").agg(F.sum("qty").alias("sold"))
    updated = _with_moves(
        products,
        sold,
        stock_qty=F.col("stock_qty") - F.col("sold"),
        sold_qty=F.col("sold_qty") + F.col("sold"),
    )
    rejected = verdicts.filter(F.col("reason").isNotNull()).select(*requests.columns, "reason")
    changed = updated.join(sold.select("product_id"), "product_id", "left_semi")
    return SalesApplied(updated, accepted, rejected, changed)


def apply_returns(
    products: DataFrame,
    sales: DataFrame,
    requests: DataFrame,
    order: Sequence[str] = ORDER,
    fold_limit: int = FOLD_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> ReturnsApplied:
    """Take back sold units, each request all or nothing against the units then left.

    ``requests`` has ``request_id, sale_id, seq, qty, defective, description``; requests
    on a sale are served in ``order``, equal places in it by id. A return lowers the sale's quantity but not its amount, and removes the sale at quantity 0; it lowers the
    product's sold count, and raises its stock unless the units are defective. Accepted
    requests come back as returns rows, refused ones with the first reason that applies:
    missing_field, bad_qty, duplicate_request, unknown_sale, exceeds_sale. Of several
    sound requests with one id the first in order counts, then the one of the smallest
    other columns. A missing request id is a missing field. A sale id that is asked for and
    held twice stops the job.
    """
    reason = F.when(
        F.col("request_id").isNull()
        | F.col("qty").isNull()
        | F.col("defective").isNull()
        | is_blank(F.col("description")),
        "missing_field",
    ).when(F.col("qty") < 1, "bad_qty")
    others = [c for c in sales.columns if c not in ("sale_id", "product_id")]
    supply = sales.select(
        "sale_id",
        "product_id",
        zero_if_null(F.col("qty")).alias("opening"),
        F.struct(*others).alias("sale"),
    )
    verdicts = grant_in_order(
        requests.withColumn("reason", reason),
        supply,
        "sale_id",
        unknown="unknown_sale",
        too_much="exceeds_sale",
        order=order,
        fold_limit=fold_limit,
        block_rows=block_rows,
        unique="request_id",
        repeated="duplicate_request",
        taken="taken",
        rest="rest",
    )
    whole = verdicts if "rest" in verdicts.columns else None
    if whole:
        verdicts = whole.filter(F.col("rest").isNull() | (F.col("rest") != UNASKED))
    granted = verdicts.filter(F.col("reason").isNull())
    accepted = granted.select(
        F.col("request_id").alias("return_id"), "product_id", "defective", "description"
    )
    held = ("product_id", "opening", "sale")
    taken = verdicts.filter(F.col("taken") > 0).select("sale_id", *held, "taken")
    spread = granted.filter(F.col("taken").isNull())  # sales whose requests lay in many tasks
    sums = None
    if not spread.isEmpty():
        sums = spread.groupBy("sale_id").agg(
            *[F.any_value(c).alias(c) for c in held], F.sum("qty").alias("taken")
        )
        taken = taken.unionByName(sums)
    spent = F.col("taken") == F.col("opening")  # known without a look at the sales

    def sales_with(rows: DataFrame, qty: Column) -> DataFrame:
        own = {"sale_id": F.col("sale_id"), "product_id": F.col("product_id"), "qty": qty}
        return rows.select(*[own.get(c, F.col("sale")[c]).alias(c) for c in sales.columns])

    if whole:  # a large batch: its shuffle had all sales that have an id
        ends = whole.filter(F.col("rest").isNotNull()).select("sale_id", *held, "taken")
        if sums:
            more = sums.select("sale_id", F.col("taken").alias("more"))
            ends = ends.join(more, "sale_id", "left").withColumn("taken", F.coalesce("more", "taken"))
        after = F.when(F.col("taken") > 0, F.col("opening") - F.col("taken")).otherwise(F.col("sale")["qty"])
        left = sales_with(ends.filter((F.col("taken") == 0) | ~spent), after).unionByName(
            sales.filter(F.col("sale_id").isNull())
        )
    else:
        left = (
            sales.join(taken.select("sale_id", "taken"), "sale_id", "left")
            .withColumn("qty", F.when(F.col("taken").isNull(), F.col("qty")).otherwise(
                F.col("qty") - F.col("taken")
            ))
            .filter(F.col("taken").isNull() | (F.col("qty") != 0))
            .select(*sales.columns)
        )
    back = granted.groupBy("product_id").agg(
        F.sum("qty").alias("returned"),
        F.sum(F.when(~F.col("defective"), F.col("qty")).otherwise(0)).alias("sound"),
    )
    updated = _with_moves(
        products,
        back,
        stock_qty=F.col("stock_qty") + F.col("sound"),
        sold_qty=F.col("sold_qty") - F.col("returned"),
    )
    rejected = verdicts.filter(F.col("reason").isNotNull()).select(*requests.columns, "reason")
    return ReturnsApplied(
        updated,
        left,
        accepted,
        rejected,
        changed_products=updated.join(back.select("product_id"), "product_id", "left_semi"),
        changed_sales=sales_with(taken.filter(~spent), F.col("opening") - F.col("taken")),
        removed_sales=taken.filter(spent).select("sale_id"),
        touched_sales=sales_with(taken, F.col("sale")["qty"]),
    )


def _with_moves(products: DataFrame, moves: DataFrame, **moved: Column) -> DataFrame:
    """Products with ``moved`` columns where ``moves`` names them, others unchanged."""
    flagged = moves.withColumn("moved", F.lit(True))
    return products.join(flagged, "product_id", "left").select(
        *[
            F.when(F.col("moved"), moved[name]).otherwise(F.col(name)).alias(name)
            if name in moved
            else F.col(name)
            for name in products.columns
        ]
    )
