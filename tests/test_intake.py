"""Product intake, exports and readers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.functions import normalize_date, percent, whole_number
from tillbook.operators import intake
from tillbook.sources import export_table, read_export, load_tables, read_raw_products, schemas


def test_missing_column_is_named(spark):
    raw = make.raw_products(spark, {}).drop("sku")
    with pytest.raises(ValueError, match="missing columns: sku"):
        intake.import_products(raw, make.categories(spark), make.producers(spark))


def test_rows_without_a_name_are_refused_and_extra_columns_ignored(spark):
    raw = make.raw_products(spark, {"product_name": None}, {"product_name": ""}, {})
    result = intake.import_products(raw.withColumn("note", F.lit("!")), make.categories(spark),
                                    make.producers(spark))
    assert make.rows_of(result.accepted) == [
        ("x", 1, Decimal("1.00"), Decimal("2.00"), "red", 1, "k", "d", 3, dt.date(2024, 12, 27))
    ]
    assert make.rows_of(result.rejected, "reason") == [("missing_name",)] * 2


def test_unknown_names_keep_the_row(spark):
    raw = make.raw_products(spark, {"category_name": "?"}, {"producer_name": None})
    accepted = intake.import_products(raw, make.categories(spark), make.producers(spark)).accepted
    assert make.sorted_rows(accepted, "category_id", "producer_id") == [(1, None), (None, 1)]


def test_a_name_held_twice_stops_the_import(spark):
    twice = make.categories(spark, (1, "lights"), (2, "lights"))
    accepted = intake.import_products(make.raw_products(spark, {}), twice,
                                      make.producers(spark)).accepted
    with pytest.raises(Exception, match="category_name is not unique: lights"):
        accepted.collect()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("45653", dt.date(2024, 12, 27)),
        ("45653.75", dt.date(2024, 12, 27)),
        ("2024-12-27", dt.date(2024, 12, 27)),
        ("2024/12/27", dt.date(2024, 12, 27)),
        ("2024-12-27 23:59:59", dt.date(2024, 12, 27)),
        ("2024-12-27T08:00:00Z", dt.date(2024, 12, 27)),
        ("0", dt.date(1899, 12, 30)),
        ("20241227", None),
        ("2024-02-30", None),
        ("not a date", None),
        ("-5", None),
        ("", None),
        (None, None),
    ],
)
def test_normalize_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "d string")
    assert make.rows_of(df.select(normalize_date(F.col("d")))) == [(expected,)]


def test_normalize_date_of_typed_columns(spark):
    df = spark.range(1).select(
        F.lit(45653).alias("a"), F.lit(45653.5).alias("b"),
        F.lit(dt.date(2024, 12, 27)).alias("c"), F.lit(dt.datetime(2024, 12, 27, 9)).alias("d"),
    )
    assert make.rows_of(df.select(*[normalize_date(F.col(c)) for c in "abcd"])) == [
        (dt.date(2024, 12, 27),) * 4
    ]


def test_unreadable_values_are_refused_and_blank_ones_kept(spark):
    raw = make.raw_products(
        spark, {"ordered_on": "not a date"}, {"buy_price": "n/a"}, {"sell_price": "?"},
        {"stock_qty": "1.5"}, {"ordered_on": None, "buy_price": "", "stock_qty": None},
    )
    result = intake.import_products(raw, make.categories(spark), make.producers(spark))
    assert make.sorted_rows(result.rejected, "reason") == [
        ("bad_buy_price",), ("bad_date",), ("bad_sell_price",), ("bad_stock_qty",)
    ]
    assert make.rows_of(result.accepted, "ordered_on", "buy_price", "stock_qty") == [
        (None, None, None)
    ]


def test_check_intake(spark):
    raw = make.raw_products(
        spark,
        {"sku": "fine", "buy_price": "7.0", "ordered_on": None, "category_name": None},
        {"sku": "names", "category_name": "?", "producer_name": "?"},
        {"sku": "numbers", "buy_price": "1.5", "sell_price": "-1", "stock_qty": "many"},
        {"sku": "early", "ordered_on": "1999-12-31"},
        {"sku": "late", "ordered_on": "2101-01-01"},
        {"sku": "edge", "ordered_on": "2100-12-31"},
        {"sku": "text", "ordered_on": "soon"},
    )
    violations = intake.check_intake(raw, make.categories(spark), make.producers(spark))
    assert make.sorted_rows(violations) == [
        ("early", "ordered_on_out_of_range"),
        ("late", "ordered_on_out_of_range"),
        ("names", "category_not_listed"),
        ("names", "producer_not_listed"),
        ("numbers", "buy_price_not_whole"),
        ("numbers", "sell_price_not_whole"),
        ("numbers", "stock_qty_not_whole"),
        ("text", "ordered_on_out_of_range"),
    ]
    counts = dict(make.rows_of(intake.count_violations(violations)))
    assert counts["ordered_on_out_of_range"] == 3
    own = intake.check_intake(raw, make.categories(spark), make.producers(spark),
                              rules={"short_sku": F.length("sku") < 5})
    assert {row[1] for row in make.rows_of(own)} == {"short_sku"}


def test_domain_values(spark):
    names = make.categories(spark, (1, "a"), (2, "a"), (3, "b"))
    assert make.sorted_rows(intake.domain_values(names, "category_name")) == [("a",), ("b",)]


def test_numbers(spark):
    df = spark.createDataFrame([(1, 3), (1, 200), (5, 0), (0, 5)], "p long, w long")
    assert [str(r[0]) for r in df.select(percent(F.col("p"), F.col("w"))).collect()] == [
        "33.33", "0.50", "0.00", "0.00"
    ]
    texts = spark.createDataFrame([("7",), ("7.0",), ("7.5",), ("x",), (None,)], "t string")
    whole = make.rows_of(texts.select(whole_number(F.col("t"))))
    assert whole == [(7,), (7,), (None,), (None,), (None,)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export_keeps_every_row_and_column(spark, tmp_path, fmt):
    goods = make.products(spark, {}, {"product_id": 2, "description": 'a "b", c', "stock_qty": None})
    path = str(tmp_path / "out")
    export_table(goods, path, fmt)
    back = read_export(spark, path, schemas.PRODUCTS, fmt)
    assert make.sorted_rows(back) == make.sorted_rows(goods)
    with pytest.raises(Exception, match="already exists"):
        export_table(goods, path, fmt)


def test_export_format_must_be_known(spark, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        export_table(make.products(spark), str(tmp_path / "out"), "xlsx")


def test_raw_files_may_hold_more_columns(spark, tmp_path):
    path = str(tmp_path / "raw")
    make.raw_products(spark, {}).withColumn("note", F.lit("!")).write.option("header", True).csv(path)
    assert read_raw_products(spark, path).columns == schemas.RAW_PRODUCT_COLUMNS


def test_load_tables(spark, tmp_path):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    tables = load_tables(spark, str(tmp_path))
    assert tables.products.schema == schemas.PRODUCTS
    assert tables.special_days.count() == 0


def test_import_and_check_reads_rows_once(spark):
    raw = make.raw_products(
        spark, {"sku": "1"}, {"sku": "2", "category_name": "nowhere"}, {"sku": "3", "buy_price": "1.5"},
        {"sku": "4", "product_name": None, "stock_qty": "-2"},
    )
    dims = make.categories(spark), make.producers(spark)
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    counted = raw.mapInArrow(read, raw.schema)
    found = intake.import_and_check(counted, *dims)
    assert found.accepted.count() + found.rejected.count() == 4
    assert reads.value == 4
    plain = intake.import_products(raw, *dims)
    assert make.sorted_rows(found.accepted) == make.sorted_rows(plain.accepted)
    assert make.sorted_rows(found.rejected) == make.sorted_rows(plain.rejected)
    separate = intake.count_violations(intake.check_intake(raw, *dims)).collect()
    assert {r.rule: r.row_count for r in separate} == {k: n for k, n in found.broken.items() if n}
    empty = intake.import_and_check(raw.limit(0), *dims)
    assert set(empty.broken.values()) == {0}
