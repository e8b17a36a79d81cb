"""Recommended actions on rows small enough to check by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import rows as make

from tillbook.operators import actions
from tillbook.sources import schemas

AS_OF = dt.date(2026, 12, 1)


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def special_days(spark, *days):
    return make.frame(spark, schemas.SPECIAL_DAYS, days)


def test_recent_cut():
    assert actions.recent_cut(dt.date(2026, 12, 31)) == dt.date(2026, 7, 1)
    assert actions.recent_cut(dt.date(2026, 3, 15)) == dt.date(2025, 10, 1)
    assert actions.recent_cut(dt.date(2026, 5, 1)) == dt.date(2025, 12, 1)


def test_places_without_sales(spark):
    sold = make.sales(spark, {"place": "B"}, {"place": "Z", "amount": Decimal("0.00")},
                      {"place": None})
    result = actions.zero_sales_places(sold, make.places(spark, "Z", "B", "A"))
    assert make.rows_of(result) == [("A, Z", 2)]
    assert make.rows_of(actions.zero_sales_places(sold, make.places(spark, "B"))) == []


def test_lowest_place_counts_null_place_and_breaks_ties_by_name(spark):
    sold = make.sales(spark, {"place": "B"}, {"place": "A"}, {"place": "C", "qty": 2,
                                                             "amount": Decimal("11.00")})
    assert make.rows_of(actions.lowest_revenue_place(sold)) == [("A", Decimal("10.00"))]
    with_null = sold.unionByName(make.sales(spark, {"place": None, "amount": Decimal("1.00")}))
    assert make.rows_of(actions.lowest_revenue_place(with_null)) == [(None, Decimal("1.00"))]


def test_reorder(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2}, {"product_id": 3})
    assert make.rows_of(actions.reorder_best_seller(goods, make.sales(spark))) == []
    sold = make.sales(spark, {"product_id": 3, "qty": 4}, {"product_id": 2, "qty": 4})
    assert make.rows_of(actions.reorder_best_seller(goods, sold)) == [(2, "lamp", 4, 10)]
    assert make.rows_of(actions.reorder_best_seller(goods, make.sales(spark, {"qty": 0}))) == []


def test_special_day_on_its_last_day(spark):
    days = special_days(spark, (1, "Old", ago(20), ago(1)), (2, "Late", ago(3), AS_OF),
                        (3, "Communion", ago(4), AS_OF), (4, "Next", ago(-5), ago(-9)))
    result = actions.next_special_day(days, AS_OF).select("id", "name", "gift_season")
    assert make.rows_of(result) == [(3, "Communion", True)]
    other = actions.next_special_day(days, AS_OF, gift_seasons={"Late"})
    assert make.rows_of(other, "gift_season") == [(False,)]
    assert make.rows_of(actions.next_special_day(days.filter("id = 1"), AS_OF)) == []


def test_producer_days(spark):
    goods = make.products(spark, *[{"product_id": i, "producer_id": i} for i in (1, 2, 3)],
                          {"product_id": 9, "producer_id": None})
    names = make.producers(spark, (1, "even"), (2, "low"), (3, "none"), (4, "no products"))
    recent, old = dt.date(2026, 7, 1), dt.date(2026, 6, 30)
    sold = make.sales(
        spark,
        {"product_id": 1, "qty": 40, "sold_on": recent}, {"product_id": 1, "qty": 60, "sold_on": old},
        {"product_id": 2, "qty": 39, "sold_on": dt.date(2027, 1, 1)},
        {"product_id": 2, "qty": 61, "sold_on": None},
    )
    result = actions.producer_days(names, goods, sold, AS_OF)
    assert make.sorted_rows(result) == [
        (2, "low", 39, 100, Decimal("39.00")),
        (3, "none", 0, 0, Decimal("0.00")),
    ]
    at_37 = actions.producer_days(names, goods, sold, AS_OF, threshold=37)
    assert make.rows_of(at_37, "producer_id") == [(3,)]


def test_slow_movers(spark):
    ages = [30, 31, 60, 61, 90, 91]
    rows = [{"product_id": d, "stock_qty": 90, "ordered_on": ago(d)} for d in ages]
    rows += [
        {"product_id": 1, "stock_qty": 89, "ordered_on": ago(91)},
        {"product_id": 2, "stock_qty": 0, "ordered_on": ago(91)},
        {"product_id": 3, "stock_qty": None, "ordered_on": ago(91)},
        {"product_id": 4, "stock_qty": 90, "ordered_on": None},
    ]
    sold = make.sales(spark, *[{"product_id": d, "qty": 10} for d in ages],
                      {"product_id": 1, "qty": 11})
    result = actions.slow_mover_discounts(make.products(spark, *rows), sold, AS_OF)
    assert sorted(make.rows_of(result, "product_id", "discount", "sold_pct")) == [
        (2, 20, Decimal("0.00")),
        (31, 5, Decimal("10.00")),
        (60, 5, Decimal("10.00")),
        (61, 10, Decimal("10.00")),
        (90, 10, Decimal("10.00")),
        (91, 20, Decimal("10.00")),
    ]


def feed(spark, goods, sold, days, places):
    result = actions.action_feed(goods, make.producers(spark), sold, days, places, AS_OF)
    return [tuple(row) for row in result.select("type", "id").collect()]


def test_feed_order_and_choice_of_place(spark):
    goods = make.products(spark, {"product_id": 1, "stock_qty": 900, "ordered_on": ago(40)},
                          {"product_id": 2, "stock_qty": 900, "ordered_on": ago(40)})
    sold = make.sales(spark, {"place": "A", "qty": 2}, {"place": "B", "amount": Decimal("3.00")})
    days = special_days(spark, (7, "Spring", AS_OF, AS_OF))
    tail = [("best_selling", "1"), ("producer_day", "1"), ("product_discount", "1"),
            ("product_discount", "2")]
    assert feed(spark, goods, sold, days, make.places(spark, "A", "C")) == [
        ("special_day_promotion", "7"), ("zero_sales_cities", "zero_sales"), *tail
    ]
    assert feed(spark, goods, sold, days, make.places(spark, "A", "B")) == [
        ("special_day_promotion", "7"), ("lowest_store_sales", "B"), *tail
    ]


def test_feed_of_nothing(spark):
    result = feed(spark, make.products(spark), make.sales(spark), special_days(spark),
                  make.places(spark))
    assert result == [("none", "none")]
