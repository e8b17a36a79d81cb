"""Every operator as a query over the retail tables derived from one source directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators import actions, catalog, compare, intake, ledger, listings, rollups, sales
from tillbook.plans.staging import AS_OF, RetailData, retail_data
from tillbook.plans.worktables import new_path
from tillbook.sources import MonthStore, export_table, read_export
from tillbook.sources.rollups import RollupStore
from tillbook.sources.schemas import TABLES

Query = Callable[[SparkSession, str], DataFrame]

# Producer share limit at which some but not all producers of the test tables fall below.
LOW_SHARE_LIMIT = 11


def _money_as_double(df: DataFrame) -> DataFrame:
    """Decimals as doubles: engines give sums of decimals different widths."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _export_roundtrip(d: RetailData, df: DataFrame, fmt: str, ranges: bool = False) -> DataFrame:
    path = new_path(d.spark, "export")
    export_table(df, path, fmt)
    return read_export(d.spark, path, df.schema, fmt, ranges)


def _import(d: RetailData) -> intake.Intake:
    return intake.import_products(d.raw_products, d.categories, d.producers)


def _import_unresolved(d: RetailData) -> DataFrame:
    rows = _import(d).accepted
    return rows.filter(F.col("category_id").isNull() | F.col("producer_id").isNull()).select(
        "sku", "category_id", "producer_id"
    )


def _without_new_ids(products: DataFrame, prefix: str) -> DataFrame:
    """Products with the ids of rows added under ``prefix`` blanked: they follow file order."""
    is_new = F.col("sku").startswith(prefix)
    return products.withColumn("product_id", F.when(~is_new, F.col("product_id")))


def _ids(products: DataFrame, prefix: str) -> DataFrame:
    """How many ids the rows added under ``prefix`` have, and their range."""
    return products.filter(F.col("sku").startswith(prefix)).agg(
        F.count("product_id").alias("ids"),
        F.countDistinct("product_id").alias("distinct_ids"),
        F.min("product_id").alias("least"),
        F.max("product_id").alias("highest"),
    )


def _import_appended(d: RetailData) -> DataFrame:
    return _without_new_ids(catalog.append_products(d.products, _import(d).accepted), "NEW-")


def _observed_counts(d: RetailData) -> DataFrame:
    broken = intake.import_and_check(d.raw_products, d.categories, d.producers).broken
    rows = [(rule, n) for rule, n in broken.items() if n]  # as many as rules
    return d.spark.createDataFrame(rows, "rule string, row_count long")


def _domain_values(d: RetailData) -> DataFrame:
    return (
        intake.domain_values(d.categories, "category_name")
        .select(F.lit("category").alias("domain"), F.col("category_name").alias("value"))
        .unionByName(
            intake.domain_values(d.producers, "producer_name").select(
                F.lit("producer").alias("domain"), F.col("producer_name").alias("value")
            )
        )
    )


def _violations(d: RetailData) -> DataFrame:
    return intake.check_intake(d.raw_products, d.categories, d.producers)


def _category_products(d: RetailData) -> DataFrame:
    return compare.category_products(d.products, d.sales)


def _producer_days(d: RetailData, threshold: float) -> DataFrame:
    return actions.producer_days(d.producers, d.products, d.sales, AS_OF, threshold=threshold)


# Sizes at which contested keys of the test tables are folded in blocks.
IN_BLOCKS = {"fold_limit": 30, "block_rows": 20_000}


def _apply_sales(d: RetailData, **sizes: int) -> ledger.SalesApplied:
    return ledger.apply_sales(d.ledger_products, d.sale_requests, AS_OF, **sizes)


def _apply_returns(d: RetailData, **sizes: int) -> ledger.ReturnsApplied:
    return ledger.apply_returns(d.products, d.sales, d.return_requests, **sizes)


def _sales_store(d: RetailData) -> MonthStore:
    """All sales in a store of their own by month."""
    store = MonthStore(d.spark, new_path(d.spark, "sales-store"), TABLES["sales"], "sale_id", "sold_on")
    store.create(d.sales)
    return store


def _store_after_returns(d: RetailData) -> DataFrame:
    store, day = _sales_store(d), _apply_returns(d)
    store.merge(changed=day.changed_sales, removed=day.removed_sales)
    return store.read().select(*TABLES["sales"].fieldNames())


def _rolled(d: RetailData) -> DataFrame:
    """The rollup of all sales after a batch of sales and one of returns."""
    store = RollupStore(d.spark, new_path(d.spark, "sales-rollup"))
    store.create(d.sales)
    store.apply(rollups.moves_of_sales(_apply_sales(d).accepted), batch=1)
    day = _apply_returns(d)
    store.apply(rollups.moves_of_returns(day.touched_sales, day.changed_sales, day.removed_sales), batch=2)
    return store.read()


def _stock(products: DataFrame) -> DataFrame:
    return products.select("product_id", "stock_qty", "sold_qty")


def _action_feed(d: RetailData, places: DataFrame) -> DataFrame:
    return actions.action_feed(d.products, d.producers, d.sales, d.special_days, places, AS_OF)


def _added(d: RetailData) -> DataFrame:
    """New products above every id that products, sales or returns know."""
    return catalog.add_products(d.products, d.new_products, [d.sales, d.returns]).products


def _changed(d: RetailData) -> catalog.Change:
    return catalog.update_products(d.products, d.product_changes)


_QUERIES: dict[str, Callable[[RetailData], DataFrame]] = {
    # sources and sinks
    "export_roundtrip": lambda d: _export_roundtrip(d, d.products, "csv"),
    "export_sales": lambda d: _export_roundtrip(d, d.sales, "parquet"),
    "export_returns": lambda d: _export_roundtrip(d, d.returns, "csv"),
    "export_returns_ranges": lambda d: _export_roundtrip(d, d.returns, "csv", ranges=True),
    "import_products": lambda d: _import(d).accepted,
    "import_rejected": lambda d: _import(d).rejected,
    "import_unresolved": _import_unresolved,
    "import_appended": _import_appended,
    "import_ids": lambda d: _ids(
        catalog.append_products(d.products, _import(d).accepted), "NEW-"
    ),
    "import_dates": lambda d: _import(d).accepted.select("sku", "ordered_on"),
    "intake_violations": _violations,
    "intake_violation_counts": lambda d: intake.count_violations(_violations(d)),
    "import_observed_counts": _observed_counts,
    "import_observed_accepted": lambda d: intake.import_and_check(
        d.raw_products, d.categories, d.producers
    ).accepted,
    "domain_values": _domain_values,
    # listings
    "product_list": lambda d: listings.product_list(d.products),
    "product_details": lambda d: listings.product_details(d.products, d.categories, d.producers),
    "product_details_left": lambda d: listings.product_details(
        d.products, d.categories, d.producers, how="left"
    ),
    "product_details_ids": lambda d: listings.product_details(
        d.products, d.categories, d.producers, ids=d.sold_out_ids
    ),
    "product_details_text_dates": lambda d: listings.product_details(
        d.text_date_products, d.categories, d.producers
    ),
    "in_stock": lambda d: listings.in_stock(d.products, d.categories, d.producers),
    "sales_list": lambda d: listings.sales_list(d.sales, d.products),
    "returns_list": lambda d: listings.returns_list(d.returns, d.products),
    # sales reports
    "margin_by_week": lambda d: sales.margin_by_period(d.sales, d.products, "week"),
    "margin_by_month": lambda d: sales.margin_by_period(d.sales, d.products, "month"),
    "margin_by_year": lambda d: sales.margin_by_period(d.sales, d.products, "year"),
    "best_worst_seller": lambda d: sales.best_and_worst(d.sales, d.products),
    "total_units_sold": lambda d: sales.total_units_sold(d.sales),
    "total_stock": lambda d: sales.total_stock(d.products),
    "units_by_mapped_place": lambda d: sales.units_by_mapped_place(d.sales, d.mapped_places),
    "units_by_producer": lambda d: sales.units_by_producer(d.sales, d.products, d.producers),
    "units_by_category": lambda d: sales.units_by_category(d.sales, d.products, d.categories),
    "revenue_by_place": lambda d: sales.revenue_by_place(d.sales),
    # comparison
    "active_categories": lambda d: compare.active_categories(d.categories, d.products, d.sales),
    "category_products": _category_products,
    "category_products_one": lambda d: compare.category_products(d.products, d.sales, 2),
    "category_best_worst": lambda d: compare.category_best_worst(_category_products(d)),
    "compare_products": lambda d: compare.compare_products(
        _category_products(d), d.product_pairs
    ),
    # recommended actions
    "zero_sales_places": lambda d: actions.zero_sales_places(d.sales, d.places),
    "lowest_revenue_place": lambda d: actions.lowest_revenue_place(d.sales),
    "reorder_best_seller": lambda d: actions.reorder_best_seller(d.products, d.sales),
    "next_special_day": lambda d: actions.next_special_day(d.special_days, AS_OF),
    "producer_days": lambda d: _producer_days(d, actions.PRODUCER_SHARE_LIMIT),
    "producer_days_low": lambda d: _producer_days(d, LOW_SHARE_LIMIT),
    "slow_mover_discounts": lambda d: actions.slow_mover_discounts(d.products, d.sales, AS_OF),
    "action_feed": lambda d: _action_feed(d, d.places),
    "action_feed_all_places_sell": lambda d: _action_feed(d, d.selling_places),
    # stock ledger and catalog
    "apply_sales_accepted": lambda d: _apply_sales(d).accepted,
    "apply_sales_rejected": lambda d: _apply_sales(d).rejected,
    "apply_sales_stock": lambda d: _stock(_apply_sales(d).products),
    "apply_sales_changed": lambda d: _stock(_apply_sales(d).changed_products),
    "apply_sales_blocks_accepted": lambda d: _apply_sales(d, **IN_BLOCKS).accepted,
    "apply_returns_accepted": lambda d: _apply_returns(d).accepted,
    "apply_returns_sales": lambda d: _apply_returns(d).sales,
    "apply_returns_stock": lambda d: _stock(_apply_returns(d).products),
    "apply_returns_rejected": lambda d: _apply_returns(d).rejected,
    "apply_returns_changed_sales": lambda d: _apply_returns(d).changed_sales,
    "apply_returns_removed_sales": lambda d: _apply_returns(d).removed_sales,
    "apply_returns_blocks_rejected": lambda d: _apply_returns(d, fold_limit=1, block_rows=20_000).rejected,
    "sales_store_after_returns": _store_after_returns,
    "sales_store_lookup": lambda d: _sales_store(d).find(d.return_requests).drop("month"),
    "rolled_sales": _rolled,
    "rolled_margin_by_week": lambda d: sales.margin_by_period(
        rollups.as_sales(_rolled(d)), d.products, "week"
    ),
    "rolled_revenue_by_place": lambda d: sales.revenue_by_place(rollups.as_sales(_rolled(d))),
    "add_products": lambda d: _without_new_ids(_added(d), "ADD-"),
    "add_products_ids": lambda d: _ids(_added(d), "ADD-"),
    "add_products_rejected": lambda d: catalog.add_products(
        d.products, d.new_products
    ).rejected,
    "update_products": lambda d: _changed(d).products,
    "update_products_changed": lambda d: _changed(d).changed,
    "update_products_rejected": lambda d: _changed(d).rejected,
    "delete_products": lambda d: catalog.delete_products(d.products, d.sold_out_ids),
}


def _bind(build: Callable[[RetailData], DataFrame]) -> Query:
    def run(spark: SparkSession, source: str) -> DataFrame:
        return _money_as_double(build(retail_data(spark, source)))

    return run


def all_queries() -> dict[str, Query]:
    return {name: _bind(build) for name, build in _QUERIES.items()}
