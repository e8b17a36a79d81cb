"""What is shuffled, joined and written once, however large the tables are."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.operators import grants, ledger, rollups
from tillbook.plans import staging
from tillbook.plans.worktables import materialize
from tillbook.sources import MonthStore
from tillbook.sources.rollups import RollupStore

SOURCE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_only_by_hint(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("most", [staging.BROADCAST_SUPPLIERS, 0])
def test_lines_become_sales_with_one_shuffle_at_most(spark, monkeypatch, small_only_by_hint, most):
    written = {}
    monkeypatch.setattr(staging, "BROADCAST_SUPPLIERS", most)
    monkeypatch.setattr(staging.RetailData, "_work", lambda self, name, df: written.setdefault(name, df))
    text = plan(staging.RetailData(spark, SOURCE).sales_lines)
    assert "rangepartitioning" not in text
    assert len(re.findall(r"hashpartitioning\(l_suppkey", text)) == (0 if most else 1)
    assert written["sales_lines"].count() == spark.read.parquet(f"{SOURCE}/lineitem.parquet").count()


def requests_with_repeats(spark):
    asked = [{"request_id": f"r{i % 40}", "seq": i, "qty": 1} for i in range(60)]
    asked.append({"request_id": "bad", "seq": 1, "qty": 0})
    return make.sale_requests(spark, *asked)


def test_repeated_requests_are_marked_once(spark, small_only_by_hint):
    sound = F.when(F.col("qty") < 1, "bad_qty")
    requests = materialize(requests_with_repeats(spark).withColumn("reason", sound), "asked")
    rows = grants._without_repeats(requests, "request_id", ("seq", "request_id"), "again")
    assert "Join" not in plan(rows)  # every reader would join anew
    assert sorted((r.request_id, r.seq) for r in rows.filter("reason = 'again'").collect()) == sorted(
        (f"r{i - 40}", i) for i in range(40, 60)
    )
    assert rows.count() == 61 and rows.filter("reason = 'bad_qty'").count() == 1


def test_keys_inside_a_block_are_not_summarised(spark, monkeypatch):
    rng = random.Random(2)
    asked = [{"request_id": f"q{i}", "product_id": rng.randrange(25), "seq": i, "qty": rng.randrange(1, 5)} for i in range(900)]
    products = make.products(spark, *[{"product_id": p, "stock_qty": 10 + p} for p in range(25)])
    requests = make.sale_requests(spark, *asked)
    seen, whole = [], grants._summarise
    monkeypatch.setattr(grants, "_summarise", lambda df, *rest: seen.append(df) or whole(df, *rest))
    for block_rows in (150, 10_000):
        got = ledger.apply_sales(products, requests, dt.date(2030, 1, 1), fold_limit=2, block_rows=block_rows)
        plain = ledger.apply_sales(products, requests, dt.date(2030, 1, 1))
        assert make.sorted_rows(got.accepted) == make.sorted_rows(plain.accepted)
    assert len(seen) == 1  # with all keys in one block there is nothing to follow
    keys = seen[0].groupBy("product_id").agg(F.countDistinct("block").alias("blocks")).collect()
    assert keys and all(r.blocks > 1 for r in keys)


def test_removed_sales_are_known_without_sales(spark):
    stock = make.products(spark, {"product_id": 1})
    sold = materialize(make.sales(spark, {"sale_id": "a", "qty": 2}, {"sale_id": "b", "qty": 2}), "sold")
    asked = make.return_requests(
        spark, {"request_id": "1", "sale_id": "a", "qty": 2}, {"request_id": "2", "sale_id": "b", "qty": 1}
    )
    day = ledger.apply_returns(stock, sold, asked)
    assert "Join" not in plan(day.removed_sales)
    assert [r.sale_id for r in day.removed_sales.collect()] == ["a"]
    assert [(r.sale_id, r.qty) for r in day.changed_sales.collect()] == [("b", 1)]


def test_large_batches_are_held_against_ranges(spark, tmp_path, monkeypatch):
    """Keys times files grows with the square of the table."""
    frame = make.sales(
        spark, *[{"sale_id": f"{m:02d}-{i}", "sold_on": dt.date(2024, m, 3)} for m in range(1, 10) for i in range(8)]
    )
    store = MonthStore(spark, str(tmp_path / "sales"), frame.schema, "sale_id", "sold_on")
    store.create(frame)
    monkeypatch.setattr("tillbook.sources.store.KEYS_BY_BIT", 3, raising=False)
    monkeypatch.setattr("tillbook.sources.store._place", None)
    ids = ["02-1", "02-7", "05-0", "05-3", "none", None]
    keys = spark.createDataFrame([(i,) for i in ids], "sale_id string")
    found = store.find(keys)
    assert sorted(r.sale_id for r in found.collect()) == ids[:4]
    assert {r.month.month for r in store.read(store.files_of(keys)).collect()} == {2, 5}


def returns_of_two_sales(spark, **sizes):
    stock = make.products(spark, {"product_id": 1})
    sold = materialize(make.sales(spark, {"sale_id": "a", "qty": 5}, {"sale_id": "b", "qty": 2}, {"sale_id": "c"}), "sold")
    asked = make.return_requests(
        spark, {"request_id": "1", "sale_id": "a", "qty": 2}, {"request_id": "2", "sale_id": "a", "qty": 1},
        {"request_id": "3", "sale_id": "b", "qty": 2}, {"request_id": "4", "sale_id": "a", "qty": 9},
        {"request_id": "5", "sale_id": None}, {"request_id": "6", "sale_id": "x"},
    )
    return ledger.apply_returns(stock, sold, asked, **sizes)


@pytest.mark.parametrize("sizes", [{}, {"fold_limit": 1, "block_rows": 2}])
def test_changed_sales_are_known_without_sales(spark, sizes):
    day = returns_of_two_sales(spark, **sizes)
    for df in (day.changed_sales, day.touched_sales, day.removed_sales):
        assert "Join" not in plan(df)
    assert [(r.sale_id, r.qty) for r in day.changed_sales.collect()] == [("a", 2)]
    assert sorted((r.sale_id, r.qty) for r in day.touched_sales.collect()) == [("a", 5), ("b", 2)]
    assert sorted((r.request_id, r.reason) for r in day.rejected.collect()) == [
        ("4", "exceeds_sale"), ("5", "unknown_sale"), ("6", "unknown_sale")
    ]


def test_requests_are_written_as_verdicts_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(grants, "materialize", lambda df, name: written.append((name, df.columns)) or materialize(df, name))
    returns_of_two_sales(spark)
    assert [name for name, columns in written if {"request_id", "sale_id"} <= set(columns)] == ["verdicts"]


@pytest.mark.parametrize("listed, bitmaps", [(100, 100), (0, 100), (0, 0)])
def test_repeats_are_found_by_list_bitmaps_and_join(spark, monkeypatch, listed, bitmaps):
    monkeypatch.setattr(grants, "LISTED_SKETCHES", listed, raising=False)
    monkeypatch.setattr(grants, "BITMAP_SKETCHES", bitmaps, raising=False)
    sound = F.when(F.col("qty") < 1, "bad_qty")
    requests = requests_with_repeats(spark).withColumn("reason", sound)
    rows = grants._without_repeats(requests, "request_id", ("seq", "request_id"), "again")
    assert sorted((r.request_id, r.seq) for r in rows.filter("reason = 'again'").collect()) == sorted(
        (f"r{i - 40}", i) for i in range(40, 60)
    )
    assert rows.count() == 61 and rows.filter("reason = 'bad_qty'").count() == 1


def test_a_rollup_is_shuffled_once_and_written_in_that_layout(spark, tmp_path, small_only_by_hint):
    rng = random.Random(4)
    sold = materialize(
        make.sales(
            spark, *[{"product_id": rng.randrange(3), "sold_on": dt.date(2024, rng.randrange(1, 4), 3), "qty": i} for i in range(90)]
        ),
        "sold",
    )
    assert plan(rollups.roll_up(sold)).count("Exchange") == 1
    store = RollupStore(spark, str(tmp_path / "rollup"))
    store.create(sold)
    store.apply(rollups.moves_of_sales(sold), batch=1)
    assert sum(r.units for r in store.read().collect()) == 2 * sum(range(90))
    assert store.read().count() == 9


@pytest.mark.parametrize("sizes", [{}, {"fold_limit": 3, "block_rows": 2}])
def test_a_large_batch_shuffles_sales_once(spark, monkeypatch, small_only_by_hint, sizes):
    rng = random.Random(5)
    day = dt.date(2024, 1, 1)
    sold = [{"sale_id": f"s{i}", "qty": rng.choice([None, 0, 1, 3, 6]), "product_id": rng.choice([1, 2, None])} for i in range(60)]
    sold += [{"sale_id": None, "qty": 2}, {"sale_id": None, "qty": None}, {"sale_id": "twice", "qty": 1}, {"sale_id": "twice", "qty": 4}]
    sold += [{"sale_id": "bare", "sold_on": None, "place": None, "amount": None, "qty": 7}, {"sale_id": "busy", "qty": 9, "sold_on": day}]
    asked = [
        {"sale_id": rng.choice(["gone", None, *[f"s{i}" for i in range(0, 60, 2)]]), "qty": rng.choice([None, 0, 1, 1, 2, 3])}
        for _ in range(50)
    ]
    asked += [{"sale_id": "busy", "qty": 1 + i % 2, "seq": i} for i in range(9)] + [{"sale_id": "bare", "qty": 3}]
    asked.append({"sale_id": "twice", "qty": 0})  # refused before anything is looked up
    requests = make.return_requests(spark, *asked, {"request_id": "r3", "sale_id": "s1", "qty": 1})
    stock = make.products(spark, {"product_id": 1}, {"product_id": 2})
    frame = materialize(make.sales(spark, *sold), "sold")
    plain = ledger.apply_returns(stock, frame, requests)
    monkeypatch.setattr(grants, "BROADCAST_KEYS", 0)
    large = ledger.apply_returns(stock, frame, requests, **sizes)
    for one, other in zip(plain, large, strict=True):
        assert one.columns == other.columns and one.dtypes == other.dtypes
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    if not sizes:  # no sale has so many requests that they are judged apart
        assert "Exchange" not in plan(large.sales)


def test_a_sale_held_twice_stops_a_large_batch(spark, monkeypatch):
    monkeypatch.setattr(grants, "BROADCAST_KEYS", 0)
    sold = make.sales(spark, {"sale_id": "a"}, {"sale_id": "a"}, {"sale_id": "b"})
    with pytest.raises(ValueError, match="a is held 2 times"):
        ledger.apply_returns(make.products(spark, {}), sold, make.return_requests(spark, {"sale_id": "a"}))
