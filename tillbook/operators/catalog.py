"""Product add, change and delete as batches over a change table.

Each operator returns new frames. Write them to a new directory, never over the
one being read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions import is_blank, zero_if_null
from tillbook.plans.worktables import materialize
from tillbook.sources.schemas import PRODUCT_ATTRIBUTES, PRODUCTS


class Change(NamedTuple):
    products: DataFrame
    rejected: DataFrame
    changed: DataFrame
    """Only the product rows that are new or differ: what a store has to write."""


def _missing_field(names: list[str]) -> Column:
    reason = F.lit(None).cast("string")
    for name in reversed(names):
        reason = F.when(is_blank(F.col(name)), f"missing_{name}").otherwise(reason)
    return reason


def assign_ids(rows: DataFrame, start: int, id_col: str) -> DataFrame:
    """Add consecutive ids from ``start``, in the order of the rows as stored.

    Two passes: the batch is written with each row's partition and place in it, then
    every partition is shifted by the rows before it. Only the counts, one row per task of
    the write, are ordered by themselves.
    """
    placed = materialize(
        rows.withColumn("_place", F.monotonically_increasing_id()), "new-rows"
    )
    # monotonically_increasing_id() is the partition number shifted left by 33 bits
    # plus the row's place in the partition.
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = materialize(
        placed.groupBy(part.alias("_part"))
        .count()
        .select(
            "_part", (zero_if_null(F.sum("count").over(before)) + start).alias("_first")
        ),
        "new-row-offsets",
    )
    return (
        placed.withColumn("_part", part)
        .join(shift, "_part")
        .withColumn(id_col, F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_first", "_place")
    )


def add_products(
    products: DataFrame, new_rows: DataFrame, ledgers: Sequence[DataFrame] = ()
) -> Change:
    """Append product rows under new ids; name, category, producer and sku are required.

    New ids follow the highest id in use, also by rows of ``ledgers`` (such as sales and
    returns) whose product was deleted, so that none is given twice. New products start
    with nothing sold and no complaints.
    """
    checked = new_rows.withColumn(
        "reason", _missing_field(["product_name", "category_id", "producer_id", "sku"])
    )
    added = _new_products(products, checked.filter(F.col("reason").isNull()), ledgers)
    return Change(
        products.unionByName(added), checked.filter(F.col("reason").isNotNull()), added
    )


def append_products(
    products: DataFrame, rows: DataFrame, ledgers: Sequence[DataFrame] = ()
) -> DataFrame:
    """Append rows that hold the product attributes, such as accepted intake rows."""
    return products.unionByName(_new_products(products, rows, ledgers))


def _new_products(
    products: DataFrame, rows: DataFrame, ledgers: Sequence[DataFrame]
) -> DataFrame:
    highest = max(
        df.agg(F.coalesce(F.max("product_id"), F.lit(0))).first()[0] for df in (products, *ledgers)
    )
    return (
        assign_ids(rows.select(*PRODUCT_ATTRIBUTES), highest + 1, "product_id")
        .withColumn("sold_qty", F.lit(0))
        .withColumn("complaint_qty", F.lit(0))
        .select(*[F.col(f.name).cast(f.dataType) for f in PRODUCTS.fields])
    )


def update_products(products: DataFrame, changes: DataFrame) -> Change:
    """Replace the product attributes by id; the counters keep their values.

    Refused: changes without a name, category, producer, sku, date or ``seq``, changes of
    an unknown id, and changes of one product that share a ``seq`` (tied_seq). Of several
    changes to one product the one with the highest ``seq`` counts.
    """
    checked = changes.withColumn(
        "reason",
        _missing_field(
            ["product_name", "category_id", "producer_id", "sku", "ordered_on", "seq"]
        ),
    )
    tied = (
        checked.filter(F.col("reason").isNull())
        .groupBy("product_id", "seq")
        .count()
        .filter("count > 1")
        .select("product_id", "seq", F.lit("tied_seq").alias("tied"))
    )
    checked = (
        checked.join(tied, ["product_id", "seq"], "left")
        .withColumn("reason", F.coalesce("reason", "tied"))
        .select(*changes.columns, "reason")
    )
    known = products.select("product_id", F.lit(True).alias("known"))
    judged = checked.join(known, "product_id", "left").withColumn(
        "reason",
        F.coalesce("reason", F.when(F.col("known").isNull(), "unknown_product")),
    )
    latest = (
        checked.filter(F.col("reason").isNull())
        .groupBy("product_id")
        .agg(F.max_by(F.struct(*PRODUCT_ATTRIBUTES), "seq").alias("new"))
    )
    merged = products.join(latest, "product_id", "left").select(
        *[
            F.when(F.col("new").isNotNull(), F.col(f"new.{name}"))
            .otherwise(F.col(name))
            .alias(name)
            if name in PRODUCT_ATTRIBUTES
            else F.col(name)
            for name in products.columns
        ]
    )
    changed = merged.join(latest.select("product_id"), "product_id", "left_semi")
    return Change(merged, judged.filter(F.col("reason").isNotNull()).drop("known"), changed)


def delete_products(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove products by id; their sales and returns stay."""
    return products.join(ids.select("product_id").distinct(), "product_id", "left_anti")
