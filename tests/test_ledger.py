"""Sales, returns and product changes applied in batches."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.operators import catalog, grants, ledger

AS_OF = dt.date(2024, 6, 1)


def test_refused_sale_leaves_stock_for_the_next(spark):
    goods = make.products(spark, {"stock_qty": 8, "sold_qty": 1})
    requests = make.sale_requests(spark, {"qty": 5}, {"qty": 4}, {"qty": 3})
    result = ledger.apply_sales(goods, requests, AS_OF)
    assert make.sorted_rows(result.accepted, "sale_id", "qty") == [("r1", 5), ("r3", 3)]
    assert make.rows_of(result.rejected, "request_id", "reason") == [("r2", "insufficient_stock")]
    assert make.rows_of(result.products, "stock_qty", "sold_qty") == [(0, 9)]


def test_sale_amount_is_current_price_times_quantity(spark):
    result = ledger.apply_sales(make.products(spark, {}), make.sale_requests(spark, {"qty": 3}), AS_OF)
    assert make.rows_of(result.accepted) == [
        ("r1", dt.date(2024, 1, 1), Decimal("7.50"), 1, "North", 3)
    ]
    assert make.rows_of(result.products, "stock_qty", "sold_qty") == [(7, 3)]


def test_sale_reasons(spark):
    goods = make.products(spark, {}, {"product_id": 2, "stock_qty": None}, {"product_id": 3})
    requests = make.sale_requests(
        spark, {"qty": None}, {"place": ""}, {"sold_on": None}, {"qty": 0}, {"qty": -1},
        {"sold_on": dt.date(2024, 6, 2)}, {"product_id": 9}, {"product_id": 2},
        {"product_id": None}, {"place": "nowhere", "sold_on": AS_OF},
    )
    result = ledger.apply_sales(goods, requests, AS_OF)
    assert make.sorted_rows(result.rejected, "request_id", "reason") == [
        ("r1", "missing_field"), ("r2", "missing_field"), ("r3", "missing_field"),
        ("r4", "bad_qty"), ("r5", "bad_qty"), ("r6", "future_date"), ("r7", "unknown_product"),
        ("r8", "insufficient_stock"), ("r9", "unknown_product"),
    ]
    assert make.rows_of(result.accepted, "sale_id") == [("r10",)]
    assert make.sorted_rows(result.products, "product_id", "stock_qty", "sold_qty") == [
        (1, 9, 1), (2, None, 0), (3, 10, 0)
    ]


def test_returns_in_order(spark):
    goods = make.products(spark, {"stock_qty": 1, "sold_qty": 20})
    sold = make.sales(spark, {"qty": 5})
    requests = make.return_requests(spark, {"qty": 2, "defective": True}, {"qty": 4}, {"qty": 3})
    result = ledger.apply_returns(goods, sold, requests)
    assert make.rows_of(result.rejected, "request_id", "reason") == [("r2", "exceeds_sale")]
    assert make.sorted_rows(result.accepted, "return_id", "product_id", "defective") == [
        ("r1", 1, True), ("r3", 1, False)
    ]
    assert make.rows_of(result.sales) == []
    assert make.rows_of(result.products, "stock_qty", "sold_qty") == [(4, 15)]


def test_partial_return_keeps_the_amount(spark):
    sold = make.sales(spark, {"qty": 5, "amount": Decimal("50.00")}, {"qty": 0}, {"qty": None})
    result = ledger.apply_returns(make.products(spark, {}), sold,
                                  make.return_requests(spark, {"qty": 2}))
    assert make.sorted_rows(result.sales, "sale_id", "qty", "amount") == [
        ("s0", 3, Decimal("50.00")), ("s1", 0, Decimal("10.00")), ("s2", None, Decimal("10.00"))
    ]


def test_return_reasons(spark):
    requests = make.return_requests(
        spark, {"qty": None}, {"defective": None}, {"description": ""}, {"qty": 0},
        {"sale_id": "gone"}, {"qty": 6},
    )
    result = ledger.apply_returns(make.products(spark, {}), make.sales(spark, {"qty": 5}), requests)
    assert make.sorted_rows(result.rejected, "request_id", "reason") == [
        ("r1", "missing_field"), ("r2", "missing_field"), ("r3", "missing_field"),
        ("r4", "bad_qty"), ("r5", "unknown_sale"), ("r6", "exceeds_sale"),
    ]


def brute_force(requests, stock):
    left = dict(stock)
    verdicts = {}
    for product, seq, ident, qty in sorted(requests):
        granted = qty <= left[product]
        if granted:
            left[product] -= qty
        verdicts[ident] = granted
    return verdicts


def contested(seed, products=5, requests=400):
    """A few products, one of which has a third of all requests."""
    rnd = random.Random(seed)
    spread = rnd.choice([3, 40, 1000])
    stock = {p: rnd.choice([0, 1, 37, 500, 4000, 10**6]) for p in range(products)}
    stock[0] = rnd.choice([900, 4000])
    made = []
    for i in range(requests):
        product = 0 if rnd.random() < 1 / 3 else rnd.randrange(products)
        qty = rnd.choice([1, rnd.randint(1, spread), max(1, stock[product] // 2), stock[product] + 1])
        made.append((product, rnd.randrange(50), f"q{i}", qty))
    return made, stock


@pytest.mark.parametrize("fold_limit", [10**6, 60, 1])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grants_match_brute_force(spark, seed, fold_limit):
    requests, stock = contested(seed)
    supply = spark.createDataFrame(list(stock.items()), "product_id long, opening long")
    asked = spark.createDataFrame(
        requests, "product_id long, seq long, request_id string, qty long"
    ).withColumn("reason", F.lit(None).cast("string"))
    verdicts = grants.grant_in_order(
        asked.repartition(3), supply, "product_id", "unknown", "too much",
        fold_limit=fold_limit, block_rows=25,
    )
    actual = {row["request_id"]: row["reason"] is None for row in verdicts.collect()}
    assert actual == brute_force(requests, stock)


def test_falling_levels_match_brute_force(spark):
    """Quantities that fit only after many refusals, so that every round has work."""
    requests = [(0, i, f"q{i:03}", q) for i, q in enumerate(
        q for k in range(200, 0, -7) for q in (1, k, 1, 2 * k, 3))]
    supply = spark.createDataFrame([(0, 1000)], "product_id long, opening long")
    asked = spark.createDataFrame(
        requests, "product_id long, seq long, request_id string, qty long"
    ).withColumn("reason", F.lit(None).cast("string"))
    verdicts = grants.grant_in_order(asked, supply, "product_id", "unknown", "too much",
                                     fold_limit=1, block_rows=4)
    actual = {row["request_id"]: row["reason"] is None for row in verdicts.collect()}
    assert actual == brute_force(requests, {0: 1000})


def test_fold_carries_state_over_arrow_batches(spark):
    requests, stock = contested(9)
    supply = spark.createDataFrame(list(stock.items()), "product_id long, opening long")
    asked = spark.createDataFrame(
        requests, "product_id long, seq long, request_id string, qty long"
    ).withColumn("reason", F.lit(None).cast("string"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 7)
    try:
        verdicts = grants.grant_in_order(asked, supply, "product_id", "unknown", "too much")
        actual = {row["request_id"]: row["reason"] is None for row in verdicts.collect()}
    finally:
        spark.conf.set(setting, before)
    assert actual == brute_force(requests, stock)


def test_fold_survives_a_join_that_turns_broadcast_at_run_time(spark):
    requests, stock = contested(12)
    supply = spark.createDataFrame(list(stock.items()), "product_id long, opening long")
    asked = spark.createDataFrame(
        requests, "product_id long, seq long, request_id string, qty long"
    ).withColumn("reason", F.lit(None).cast("string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        verdicts = grants.grant_in_order(
            asked.repartition(5), supply, "product_id", "unknown", "too much"
        )
        actual = {row["request_id"]: row["reason"] is None for row in verdicts.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert actual == brute_force(requests, stock)


def test_hot_product_in_blocks_gives_the_same_ledger(spark):
    requests, stock = contested(4, requests=200)
    goods = make.products(spark, *[{"product_id": p, "stock_qty": s} for p, s in stock.items()])
    asked = make.sale_requests(
        spark, *[{"product_id": p, "seq": s, "request_id": i, "qty": q} for p, s, i, q in requests]
    )
    folded = ledger.apply_sales(goods, asked, AS_OF)
    in_blocks = ledger.apply_sales(goods, asked.repartition(5), AS_OF, fold_limit=10, block_rows=9)
    for name in folded._fields:
        assert make.sorted_rows(getattr(folded, name)) == make.sorted_rows(getattr(in_blocks, name))


def test_added_products_get_consecutive_new_ids(spark):
    goods = make.products(spark, {"product_id": 7}, {"product_id": 3})
    new = make.products(
        spark, *[{"sku": f"n{i:02}"} for i in range(20)], {"sku": ""}, {"product_name": None},
        {"category_id": None}, {"producer_id": None}, {"sku": None},
    ).drop("product_id", "sold_qty", "complaint_qty").repartition(4)
    result = catalog.add_products(goods, new)
    added = make.rows_of(result.products.filter("product_id > 7"), "product_id", "sold_qty",
                         "complaint_qty")
    assert sorted(added) == [(i, 0, 0) for i in range(8, 28)]
    assert result.products.count() == 22
    assert make.sorted_rows(result.rejected, "reason") == [
        ("missing_category_id",), ("missing_producer_id",), ("missing_product_name",),
        ("missing_sku",), ("missing_sku",),
    ]


def test_ids_follow_the_order_of_the_rows(spark):
    new = spark.range(0, 50, numPartitions=6).withColumnRenamed("id", "n")
    numbered = catalog.assign_ids(new, 100, "id")
    assert sorted(make.rows_of(numbered, "n", "id")) == [(n, n + 100) for n in range(50)]


def test_updates(spark):
    goods = make.products(spark, {"product_id": 1, "sold_qty": 5}, {"product_id": 2})
    changes = make.products(
        spark, {"product_id": 1, "product_name": "first", "stock_qty": None},
        {"product_id": 1, "product_name": "last", "stock_qty": None},
        {"product_id": 1, "product_name": ""}, {"product_id": 8},
        {"product_id": 2, "ordered_on": None},
    ).drop("sold_qty", "complaint_qty").coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    result = catalog.update_products(goods, changes)
    assert make.sorted_rows(result.products, "product_id", "product_name", "stock_qty", "sold_qty") == [
        (1, "last", None, 5), (2, "lamp", 10, 0)
    ]
    assert make.sorted_rows(result.rejected, "product_id", "reason") == [
        (1, "missing_product_name"), (2, "missing_ordered_on"), (8, "unknown_product")
    ]


def test_deletes(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2})
    ids = spark.createDataFrame([(1,), (1,), (9,)], "product_id long")
    assert make.rows_of(catalog.delete_products(goods, ids), "product_id") == [(2,)]
