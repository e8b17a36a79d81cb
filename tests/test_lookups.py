"""What is broadcast is built on the driver, so it is bounded by rows, not by compressed files."""

from __future__ import annotations

import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.functions import lookup
from tillbook.functions.joins import BROADCAST_ROWS
from tillbook.operators import listings, rollups, sales
from tillbook.plans.worktables import materialize
from tillbook.sources.rollups import RollupStore
from tillbook.sources.schemas import PRODUCTS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many_products(spark, tmp_path_factory):
    """More products than are broadcast, in files far under Spark's threshold."""
    path = str(tmp_path_factory.mktemp("many") / "products")
    one = make.products(spark, {}).drop("product_id")
    ids = spark.range(BROADCAST_ROWS + 1).withColumnRenamed("id", "product_id")
    ids.join(F.broadcast(one)).select(*PRODUCTS.fieldNames()).write.parquet(path)
    return spark.read.schema(PRODUCTS).parquet(path)


@pytest.fixture
def sold(spark):
    return make.sales(
        spark, {"product_id": 7, "qty": 2}, {"product_id": 7, "qty": None}, {"product_id": 8, "qty": 4},
        {"product_id": -1, "qty": 9}, {"product_id": None, "qty": 9},
    )


def by_shuffle(df) -> bool:
    text = plan(df)
    return "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_many_products_are_not_broadcast_to_lists(many_products, sold):
    returns = sold.select(
        F.col("sale_id").alias("return_id"), "product_id", F.lit(True).alias("defective"), F.lit("x").alias("description")
    )
    for found in (listings.returns_list(returns, many_products), listings.sales_list(sold, many_products)):
        assert by_shuffle(found)
        assert sorted((r.product_id, r.product_name) for r in found.collect()) == [(7, "lamp"), (7, "lamp"), (8, "lamp")]


def test_many_products_are_not_broadcast_to_reports(many_products, sold, spark):
    margin = sales.margin_by_period(sold, many_products, "week")
    assert by_shuffle(margin)
    assert [int(r.total_margin) for r in margin.collect()] == [9]
    ends = sales.best_and_worst(sold, many_products)
    assert by_shuffle(ends)
    assert sorted((r.kind, r.product_id) for r in ends.collect()) == [("best", 8), ("worst", 7)]
    units = sales.units_by_producer(sold, many_products, make.producers(spark))
    assert "SortMergeJoin [product_id" in plan(units)
    assert [r.total_qty for r in units.collect()] == [6]


def test_many_products_are_not_broadcast_to_a_rollup(many_products, sold, spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "rollup"))
    store.create(sold)
    margin = sales.margin_by_period(rollups.as_sales(store.read()), many_products, "week")
    assert by_shuffle(margin)
    assert [int(r.total_margin) for r in margin.collect()] == [9]


def test_few_products_are_still_left_to_spark(spark, sold):
    few = materialize(make.products(spark, {"product_id": 7}), "few")
    assert lookup(few) is few
    assert "BroadcastHashJoin" in plan(listings.sales_list(sold, few))
