"""Sales reports, comparison and listings on rows small enough to check by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.operators import compare, listings, sales
from tillbook.sources import schemas


def day(text):
    return dt.date.fromisoformat(text)


def test_weeks_start_on_sunday(spark):
    sold = make.sales(
        spark,
        *[{"sold_on": day(d)} for d in ("2024-12-28", "2024-12-29", "2025-01-01")],
    )
    margin = sales.margin_by_period(sold, make.products(spark, {}), "week")
    assert make.sorted_rows(margin) == [
        (day("2024-12-22"), Decimal("1.50")),
        (day("2024-12-29"), Decimal("3.00")),
    ]


def test_margin_of_null_quantities_is_zero_and_null_date_is_a_period(spark):
    sold = make.sales(
        spark, {"qty": None, "sold_on": day("2024-02-10")}, {"sold_on": None, "qty": 2}
    )
    margin = sales.margin_by_period(sold, make.products(spark, {}), "month")
    assert make.sorted_rows(margin) == [(day("2024-02-01"), 0), (None, Decimal("3.00"))]


def test_unknown_period(spark):
    with pytest.raises(ValueError, match="day"):
        sales.margin_by_period(make.sales(spark), make.products(spark), "day")


def test_best_and_worst_break_ties_by_id_and_skip_unsold(spark):
    goods = make.products(spark, *[{"product_id": i, "product_name": n} for i, n in
                                   enumerate("ABCDE", start=1)])
    sold = make.sales(spark, *[{"product_id": i, "qty": q} for i, q in
                               ((1, 5), (2, 5), (3, 2), (4, 2))])
    assert make.sorted_rows(sales.best_and_worst(sold, goods)) == [
        ("best", 1, "A", 5),
        ("worst", 4, "D", 2),
    ]


def test_best_and_worst_of_nothing_is_empty(spark):
    assert make.rows_of(sales.best_and_worst(make.sales(spark), make.products(spark, {}))) == []


def test_null_total_ranks_last(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2})
    sold = make.sales(spark, {"product_id": 1, "qty": None}, {"product_id": 2, "qty": -3})
    ranked = sales.best_and_worst(sold, goods).select("kind", "product_id")
    assert make.sorted_rows(ranked) == [("best", 2), ("worst", 1)]


def test_totals_of_nothing_are_one_null_row(spark):
    assert make.rows_of(sales.total_units_sold(make.sales(spark))) == [(None,)]
    assert make.rows_of(sales.total_stock(make.products(spark))) == [(None,)]


def test_mapped_places(spark):
    places = make.places(spark, "A", "B", "C", "D")
    sold = make.sales(spark, {"place": "A", "qty": 9}, {"place": "elsewhere", "qty": 5})
    result = sales.units_by_mapped_place(sold, places).select("place", "total_qty", "radius")
    assert make.sorted_rows(result) == [
        ("A", 9, 6.0), ("B", 0, 0.0), ("C", 0, 0.0), ("D", 0, 0.0)
    ]
    assert make.rows_of(sales.units_by_mapped_place(make.sales(spark), places)) == []


def test_producers_of_one_name_are_one_row(spark):
    goods = make.products(spark, {"product_id": 1, "producer_id": 1},
                          {"product_id": 2, "producer_id": 2})
    sold = make.sales(spark, {"product_id": 1, "qty": 3}, {"product_id": 2, "qty": 4},
                      {"product_id": 99, "qty": 50})
    names = make.producers(spark, (1, "Acme"), (2, "Acme"))
    assert make.rows_of(sales.units_by_producer(sold, goods, names)) == [("Acme", 7)]


def test_revenue_orders_places_and_keeps_null_place(spark):
    sold = make.sales(spark, {"place": None, "amount": Decimal("5.00")},
                      {"place": "A", "amount": Decimal("7.00")},
                      {"place": "B", "amount": Decimal("1.00")})
    assert make.rows_of(sales.revenue_by_place(sold)) == [
        ("A", Decimal("7.00")), (None, Decimal("5.00")), ("B", Decimal("1.00"))
    ]


def test_category_without_stock_and_sales_is_not_active(spark):
    goods = make.products(spark, {"product_id": 1, "category_id": 1, "stock_qty": 0},
                          {"product_id": 2, "category_id": 2, "stock_qty": 0},
                          {"product_id": 3, "category_id": 3, "stock_qty": 4})
    names = make.categories(spark, (1, "a"), (2, "b"), (3, "c"), (4, "d"))
    sold = make.sales(spark, {"product_id": 2, "qty": 1})
    assert make.sorted_rows(compare.active_categories(names, goods, sold)) == [(2, "b"), (3, "c")]


def test_category_best_and_worst_count_unsold_products(spark):
    goods = make.products(spark, *[{"product_id": i, "stock_qty": s} for i, s in
                                   ((1, 0), (2, 1), (3, 1), (4, 0))])
    members = compare.category_products(goods, make.sales(spark, {"qty": 3}), 1)
    assert make.sorted_rows(members, "product_id") == [(1,), (2,), (3,)]
    ends = compare.category_best_worst(members).select("kind", "product_id", "units_sold")
    assert make.sorted_rows(ends) == [("best", 1, 3), ("worst", 3, 0)]


def test_one_category_is_a_slice_of_all(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2, "category_id": 2},
                          {"product_id": 3, "category_id": None})
    sold = make.sales(spark, {})
    every = compare.category_products(goods, sold)
    assert make.sorted_rows(every, "product_id") == [(1,), (2,)]
    assert make.sorted_rows(every.filter("category_id = 2")) == make.sorted_rows(
        compare.category_products(goods, sold, 2)
    )


def test_compare_products(spark):
    goods = make.products(spark, {"product_id": 1, "product_name": "A"},
                          {"product_id": 2, "product_name": "B", "stock_qty": None})
    sold = make.sales(spark, {"product_id": 2, "qty": 3, "amount": Decimal("9.50")})
    pairs = spark.createDataFrame([(10, 1, 2), (11, 2, 7), (12, 7, 8)],
                                  "pair_id long, product_1 long, product_2 long")
    result = compare.compare_products(compare.category_products(goods, sold), pairs)
    assert sorted(make.rows_of(result.filter("pair_id = 10").drop("pair_id"))) == [
        (1, "name", "A", "B"),
        (2, "buy_price", "1.00", "1.00"),
        (3, "sell_price", "2.50", "2.50"),
        (4, "color", "red", "red"),
        (5, "stock", "10", None),
        (6, "units_sold", "0", "3"),
        (7, "revenue", "0.00", "9.50"),
    ]
    one_sided = result.filter("pair_id = 11 and parameter = 'name'")
    assert make.rows_of(one_sided, "product_1", "product_2") == [("B", None)]
    assert result.filter("pair_id = 12").count() == 0


def test_details_of_unknown_producer(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2, "producer_id": 77})
    args = (goods, make.categories(spark), make.producers(spark))
    assert make.rows_of(listings.product_details(*args), "product_id") == [(1,)]
    left = listings.product_details(*args, how="left")
    assert make.sorted_rows(left, "product_id", "producer_name") == [(1, "Acme"), (2, None)]
    assert make.rows_of(listings.product_details(*args, ids=[2], how="left"), "product_id") == [(2,)]
    ids = spark.createDataFrame([(1,), (1,)], "product_id long")
    assert make.rows_of(listings.product_details(*args, ids=ids), "product_id") == [(1,)]
    with pytest.raises(ValueError, match="outer"):
        listings.product_details(*args, how="outer")


@pytest.mark.parametrize(
    ("stored", "expected"),
    [("1735257600", "2024-12-27"), ("2024-12-27", "2024-12-27"), (None, None), ("soon", None)],
)
def test_details_repair_stored_dates(spark, stored, expected):
    goods = make.products(spark, {}).withColumn("ordered_on", F.lit(stored).cast("string"))
    details = listings.product_details(goods, make.categories(spark), make.producers(spark))
    assert make.rows_of(details, "ordered_on") == [(expected and day(expected),)]


def test_details_repair_epoch_numbers(spark):
    goods = make.products(spark, {}).withColumn("ordered_on", F.lit(1735257600.0))
    details = listings.product_details(goods, make.categories(spark), make.producers(spark))
    assert make.rows_of(details, "ordered_on") == [(day("2024-12-27"),)]


def test_in_stock(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2, "stock_qty": 0},
                          {"product_id": 3, "stock_qty": None},
                          {"product_id": 4, "category_id": None})
    result = listings.in_stock(goods, make.categories(spark), make.producers(spark))
    assert make.rows_of(result, "product_id") == [(1,)]


def test_sales_list_hides_orphans(spark):
    sold = make.sales(spark, {"product_id": 1}, {"product_id": 5})
    result = listings.sales_list(sold, make.products(spark, {}))
    assert make.rows_of(result, "sale_id") == [("s0",)]


def test_returns_list_flag(spark):
    returned = make.frame(spark, schemas.RETURNS,
                          [("a", 1, True, "x"), ("b", 1, False, "x"), ("c", 1, None, "x")])
    result = listings.returns_list(returned, make.products(spark, {}))
    assert make.sorted_rows(result, "return_id", "defective") == [
        ("a", "yes"), ("b", "no"), ("c", "no")
    ]
