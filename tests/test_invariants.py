"""Properties that hold on the given tables, and independence from row order."""

from __future__ import annotations

import pytest
import rows as make
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from tillbook.operators import actions, ledger, sales
from tillbook.plans.staging import AS_OF, retail_data

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return retail_data(spark, SOURCE)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_entry_has_rows(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["period", "total_margin"]
    assert df.count() > 0


def test_staged_tables_cover_the_given_ones(data):
    assert data.sales.count() == data.read("lineitem").count()
    assert data.sales.select("sale_id").distinct().count() == data.sales.count()
    assert data.products.count() == data.read("part").count()
    assert data.special_days.count() == data.read("orders").count()
    assert data.raw_products.count() == data.read("part").count()


def test_margin_is_the_same_over_weeks_months_and_years(data):
    sums = {
        total(sales.margin_by_period(data.sales, data.products, period), "total_margin")
        for period in ("week", "month", "year")
    }
    assert len(sums) == 1


def test_producer_units_are_all_units_but_those_without_a_producer(data):
    known = data.products.join(data.producers, "producer_id").select("product_id")
    lost = total(data.sales.join(known, "product_id", "left_anti"), "qty")
    by_producer = sales.units_by_producer(data.sales, data.products, data.producers)
    assert total(by_producer, "total_qty") == sales.total_units_sold(data.sales).first()[0] - lost


def test_sales_move_units_from_stock_to_sold(data):
    before = data.ledger_products
    after, accepted, rejected, _ = ledger.apply_sales(before, data.sale_requests, AS_OF)
    assert after.filter("stock_qty < 0").count() == 0
    assert total(after, "stock_qty") + total(accepted, "qty") == total(before, "stock_qty")
    assert accepted.count() + rejected.count() == data.sale_requests.count()


def test_returns_move_units_back(data):
    result = ledger.apply_returns(data.products, data.sales, data.return_requests)
    returned = total(data.sales, "qty") - total(result.sales, "qty")
    granted = data.return_requests.join(
        result.rejected.select("request_id", "seq"), ["request_id", "seq"], "left_anti"
    )
    assert total(granted, "qty") == returned
    known = granted.join(data.sales.select("sale_id", "product_id"), "sale_id").join(
        data.products.filter("stock_qty is not null"), "product_id", "left_semi"
    )
    assert total(result.products, "stock_qty") - total(data.products, "stock_qty") == total(
        known.filter("not defective"), "qty"
    )


def test_shares_are_percentages(data):
    past = data.sales.filter(F.col("sold_on") <= F.lit(AS_OF))
    days = actions.producer_days(data.producers, data.products, past, AS_OF, threshold=101)
    assert days.filter("recent_pct not between 0 and 100").count() == 0
    slow = actions.slow_mover_discounts(data.products, data.sales, AS_OF)
    assert slow.filter("sold_pct not between 0 and 100").count() == 0


def test_results_do_not_depend_on_row_order(data):
    products, sold = data.products, data.sales
    mixed_products, mixed = products.repartition(7, F.rand(1)), sold.repartition(5, F.rand(2))
    for report in (
        lambda p, s: sales.margin_by_period(s, p, "week"),
        lambda p, s: sales.best_and_worst(s, p),
        lambda p, s: actions.reorder_best_seller(p, s),
        lambda p, s: actions.slow_mover_discounts(p, s, AS_OF),
        lambda p, s: actions.lowest_revenue_place(s),
    ):
        assert make.sorted_rows(report(products, sold)) == make.sorted_rows(
            report(mixed_products, mixed)
        )
    requests = data.sale_requests
    first = ledger.apply_sales(data.ledger_products, requests, AS_OF)
    second = ledger.apply_sales(data.ledger_products, requests.repartition(6, F.rand(3)), AS_OF,
                                fold_limit=10, block_rows=50)
    assert make.sorted_rows(first.accepted) == make.sorted_rows(second.accepted)
    assert make.sorted_rows(first.products) == make.sorted_rows(second.products)
