"""Cases that clean fixtures do not show: foreign CSV, repeats, ties, reused ids, left-overs."""

from __future__ import annotations

import csv
import datetime as dt
import random

import numpy as np
import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.functions.dates import stored_date
from tillbook.operators import catalog, grants, intake, ledger, sales
from tillbook.plans.staging import retail_data
from tillbook.plans.worktables import drop_work_tables, materialize, work_folder, work_tables
from tillbook.sources import export_table, read_export, read_raw_products, schemas

AS_OF = dt.date(2024, 6, 1)


def write_csv(path, columns, *cells):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows([row[c] for c in columns] for row in cells)


def test_csv_of_a_spreadsheet(spark, tmp_path):
    columns = schemas.RAW_PRODUCT_COLUMNS
    cell = dict.fromkeys(columns, "1") | {
        "product_name": 'lamp "XL", red', "description": "two\nlines ", "sku": "A"
    }
    other = cell | {"sku": "B", "buy_price": "2", "sell_price": "3"}
    write_csv(tmp_path / "a.csv", columns, cell)
    write_csv(tmp_path / "b.csv", ["note", *reversed(columns)], other | {"note": "n"})
    found = {r.sku: r.asDict() for r in read_raw_products(spark, str(tmp_path)).collect()}
    assert found == {"A": cell, "B": other}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export_is_lossless(spark, tmp_path, fmt):
    texts = ['say "no", twice', " lead and trail ", "a\nb\r\nc", "", None, "\\", '"', ","]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    export_table(df, str(tmp_path / "x"), fmt)
    back = read_export(spark, str(tmp_path / "x"), df.schema, fmt)
    assert make.sorted_rows(back) == make.sorted_rows(df)


def test_export_by_month_prunes(spark, tmp_path):
    sold = make.sales(spark, {"sold_on": dt.date(2024, 1, 5)}, {"sale_id": "b", "sold_on": dt.date(2024, 3, 9)})
    export_table(sold, str(tmp_path / "s"), month_of="sold_on")
    march = spark.read.parquet(str(tmp_path / "s")).filter(F.col("month") == dt.date(2024, 3, 1))
    assert "PartitionFilters: [isnotnull(month" in march._jdf.queryExecution().executedPlan().toString()
    assert [r.sale_id for r in march.collect()] == ["b"]


def test_a_request_given_twice_is_served_once(spark):
    asked = make.sale_requests(
        spark,
        {"request_id": "a", "seq": 2, "qty": 1}, {"request_id": "a", "seq": 1, "qty": 2},
        {"request_id": "a", "seq": 0, "qty": 0}, {"request_id": "b", "seq": 3, "qty": 1},
    )
    result = ledger.apply_sales(make.products(spark, {"stock_qty": 10}), asked, AS_OF)
    assert sorted((r.sale_id, r.qty) for r in result.accepted.collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.seq, r.reason) for r in result.rejected.collect()) == [
        (0, "bad_qty"), (2, "duplicate_request"),
    ]
    assert [r.stock_qty for r in result.changed_products.collect()] == [7]


def test_a_sale_held_twice_stops_returns(spark):
    sold = make.sales(spark, {"sale_id": "s", "qty": 5}, {"sale_id": "s", "qty": 5})
    with pytest.raises(ValueError, match="sale_id s is held 2 times"):
        ledger.apply_returns(make.products(spark, {}), sold, make.return_requests(spark, {"sale_id": "s"}))


def test_returns_give_changes_alone(spark):
    sold = make.sales(spark, {"sale_id": "s", "qty": 5}, {"sale_id": "t", "qty": 2}, {"sale_id": "u"})
    asked = make.return_requests(
        spark, {"request_id": "1", "sale_id": "s", "qty": 2}, {"request_id": "2", "sale_id": "t", "qty": 2}
    )
    result = ledger.apply_returns(make.products(spark, {}), sold, asked)
    assert [(r.sale_id, r.qty) for r in result.changed_sales.collect()] == [("s", 3)]
    assert [r.sale_id for r in result.removed_sales.collect()] == ["t"]


def test_changes_without_an_order_are_refused(spark):
    goods = make.products(spark, {"product_id": 1}, {"product_id": 2})
    base = goods.drop("sold_qty", "complaint_qty").withColumn("color", F.lit("new"))
    seq = F.when(F.col("product_id") == 1, F.lit(None).cast("long")).otherwise(F.lit(1).cast("long"))
    changes = base.withColumn("seq", seq)
    changes = changes.unionByName(changes.filter("product_id = 2"))
    result = catalog.update_products(goods, changes)
    assert sorted(r.reason for r in result.rejected.collect()) == ["missing_seq", "tied_seq", "tied_seq"]
    assert result.changed.count() == 0 and result.products.filter("color = 'new'").count() == 0


def test_ids_of_deleted_products_are_not_given_again(spark):
    goods = make.products(spark, {"product_id": 1})
    new = goods.drop("product_id", "sold_qty", "complaint_qty")
    added = catalog.add_products(goods, new, [make.sales(spark, {"product_id": 9})])
    assert [r.product_id for r in added.changed.collect()] == [10]


def test_a_name_held_twice_stops_readers_of_refused_rows(spark):
    raw = make.raw_products(spark, {"product_name": ""})
    name = raw.first().category_name
    names = make.categories(spark, (1, name), (2, name))
    for part in intake.import_products(raw, names, make.producers(spark)):
        with pytest.raises(Exception, match="category_name is not unique"):
            part.select("sku").collect()


def test_text_dates_before_1970_and_far_off(spark):
    df = spark.createDataFrame([("-86400",), ("95617584000",), ("-1.5",), ("2001/5/6",), ("x",)], "d string")
    assert [r[0] for r in df.select(stored_date(df, "d")).collect()] == [
        dt.date(1969, 12, 31), dt.date(5000, 1, 1), dt.date(1969, 12, 31), dt.date(2001, 5, 6), None,
    ]


def test_work_tables_are_removed(spark):
    fs = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark)).getFileSystem(
        spark._jsc.hadoopConfiguration()
    )

    def folders():
        path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
        return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()

    materialize(spark.range(1), "kept")
    before = folders()
    with work_tables(spark):
        assert materialize(spark.range(3), "inside").count() == 3
        assert folders() != before
    assert folders() == before


def test_margin_shuffles_periods_alone_when_products_are_broadcast(spark):
    data = retail_data(spark, "/root/testdata/sf0.001")
    df = sales.margin_by_period(data.sales, data.products, "month")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(product_id" not in text


def test_equal_places_in_order_have_one_winner(spark):
    """Two sound requests of one id and seq: the smaller quantity comes first."""
    asked = make.sale_requests(
        spark,
        {"request_id": "a", "seq": 1, "qty": 7}, {"request_id": "a", "seq": 1, "qty": 4},
        {"request_id": "b", "seq": 1, "qty": 6}, {"request_id": "c", "seq": 1, "qty": 1},
        {"request_id": "c", "seq": 1, "qty": 1}, {"request_id": None, "seq": 0, "qty": 1},
    )
    for requests in (asked, asked.repartition(5), asked.orderBy(F.desc("qty")).coalesce(1)):
        result = ledger.apply_sales(make.products(spark, {"stock_qty": 10}), requests, AS_OF)
        assert make.sorted_rows(result.accepted, "sale_id", "qty") == [("a", 4), ("b", 6)]
        assert sorted((str(r.request_id), r.qty, r.reason) for r in result.rejected.collect()) == [
            ("None", 1, "missing_field"), ("a", 7, "duplicate_request"),
            ("c", 1, "duplicate_request"), ("c", 1, "insufficient_stock"),
        ]


def served_one_by_one(qty, starts, left):
    left, granted, unit = list(left), [], -1
    for i, q in enumerate(qty):
        if unit + 1 < len(starts) and i == starts[unit + 1]:
            unit += 1
        granted.append(q <= left[unit])
        left[unit] -= q * granted[-1]
    return granted, left


@pytest.mark.parametrize("seed", range(8))
def test_level_jumps_match_serving_one_by_one(seed):
    rng = random.Random(seed)
    top = rng.choice([3, 50, 10**6, 2**61])
    for _ in range(60):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))]
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        left = [rng.choice([0, 1, rng.randrange(top), top]) for _ in sizes]
        qty = [rng.randrange(1, rng.choice([2, 5, top + 1, top * 2])) for _ in range(sum(sizes))]
        granted, rest = grants.fold(np.array(qty), np.array(starts), np.array(left))
        assert (granted.tolist(), [int(x) for x in rest]) == served_one_by_one(qty, starts, left)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_a_unit_may_lie_in_many_arrow_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = random.Random(batch)
        asked = [(rng.choice("aab"), i, f"q{i}", rng.randrange(1, 30)) for i in range(300)]
        requests = spark.createDataFrame(asked, "product_id string, seq long, request_id string, qty long")
        supply = spark.createDataFrame([("a", 900), ("b", 55)], "product_id string, opening long")
        left = {"a": 900, "b": 55}
        expected = set()
        for key, _, ident, qty in asked:
            if qty <= left[key]:
                left[key] -= qty
                expected.add(ident)
        for limit in (1000, 10):
            judged = grants.grant_in_order(
                requests.withColumn("reason", F.lit(None).cast("string")), supply, "product_id",
                "unknown", "too_much", fold_limit=limit, block_rows=40,
            )
            assert {r.request_id for r in judged.filter("reason is null").collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
