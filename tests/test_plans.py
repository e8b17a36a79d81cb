"""The plans Spark makes of the queries: pushdown, pruning, joins and shuffles."""

from __future__ import annotations

import re

import pytest

from pyspark.sql import functions as F

from tillbook.operators import actions, compare, grants, listings, sales
from tillbook.plans.registry import all_queries
from tillbook.plans.staging import AS_OF, retail_data
from tillbook.plans.worktables import materialize

SOURCE = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def data(spark):
    return retail_data(spark, SOURCE)


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def plan(df) -> str:
    """The plan as text, without the final run's details."""
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", text)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_window_over_everything(name, spark):
    text = plan(QUERIES[name](spark, SOURCE))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Window" not in text


def test_small_tables_are_broadcast_and_products_not_shuffled(data):
    text = plan(listings.product_details(data.products, data.categories, data.producers))
    assert text.count("BroadcastHashJoin") == 2
    assert "hashpartitioning" not in text


def test_large_tables_are_joined_by_shuffle(data, no_broadcast):
    text = plan(sales.margin_by_period(data.sales, data.products, "month"))
    assert "BroadcastHashJoin" not in text
    assert "SortMergeJoin" in text


def test_margin_reads_only_what_it_needs(data):
    text = plan(sales.margin_by_period(data.sales, data.products, "month"))
    columns = {re.sub(r"#\d+L?", "", scan) for scan in scans(text)}
    assert columns == {"sold_on,product_id,qty", "product_id,buy_price,sell_price"}


def test_sales_are_summed_before_they_are_shuffled(data, no_broadcast):
    for report in (
        sales.units_by_producer(data.sales, data.products, data.producers),
        compare.category_products(data.products, data.sales),
        actions.reorder_best_seller(data.products, data.sales),
    ):
        text = plan(report)
        lines = text.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "qty#" in line
                    and "stock_qty" not in line)
        above = [line for line in lines[:scan] if "Exchange" in line or "partial_sum" in line]
        assert "partial_sum" in above[-1]


def test_margin_shuffles_three_columns_of_sales_once(data, no_broadcast):
    text = plan(sales.margin_by_period(data.sales, data.products, "month"))
    keys = re.findall(r"Exchange hashpartitioning\((\w+?)#", text)
    assert sorted(keys) == sorted(["product_id", "product_id", keys[0]]) and keys[0] != "product_id"
    assert "partial_sum" in text
    assert {re.sub(r"#\d+L?", "", scan) for scan in scans(text)} == {
        "sold_on,product_id,qty", "product_id,buy_price,sell_price"
    }


def test_requests_are_not_shuffled_by_their_ids(spark, data):
    """Ids that may repeat are found by sketches; the rest is judged by product alone."""
    sound = data.sale_requests.filter("qty > 0").withColumn("reason", F.lit(None).cast("string"))
    judged = grants.grant_in_order(
        sound.dropDuplicates(["request_id"]).transform(lambda df: materialize(df, "once")),
        data.products.select("product_id", F.coalesce("stock_qty", F.lit(0)).alias("opening")),
        "product_id",
        "unknown",
        "too_much",
        unique="request_id",
        repeated="again",
    )
    assert not re.search(r"Exchange hashpartitioning\(request_id", plan(judged))


def test_stock_filters_reach_the_scan(data):
    text = plan(listings.in_stock(data.products, data.categories, data.producers))
    assert "GreaterThan(stock_qty,0)" in text
    text = plan(actions.slow_mover_discounts(data.products, data.sales, AS_OF))
    assert "LessThan(ordered_on,2001-07-01)" in text
    text = plan(actions.next_special_day(data.special_days, AS_OF))
    assert "GreaterThanOrEqual(ends_on,2001-07-31)" in text
    text = plan(compare.category_products(data.products, data.sales, 3))
    assert "EqualTo(category_id,3)" in text


def test_best_and_worst_do_not_sort(data):
    text = plan(sales.best_and_worst(data.sales, data.products))
    assert "rangepartitioning" not in text
    text = plan(actions.reorder_best_seller(data.products, data.sales))
    assert "TakeOrderedAndProject" in text
