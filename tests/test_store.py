"""Tables stored by month: merged batches, rows found by id, files left alone."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
import rows as make
from pyspark.sql import functions as F

from tillbook.operators import ledger
from tillbook.sources import MonthStore, schemas
from tillbook.sources.store import replace_months


def month_files(spark, store):
    return {r[0]: r[1] for r in store.read().select("month", F.input_file_name()).distinct().collect()}


def new_store(spark, tmp_path, *sold):
    frame = make.sales(spark, *sold)
    store = MonthStore(spark, str(tmp_path / "sales"), frame.schema, "sale_id", "sold_on")
    store.create(frame)
    return store


def test_returns_touch_their_months_alone(spark, tmp_path):
    store = new_store(
        spark, tmp_path,
        {"sale_id": "a", "qty": 5, "sold_on": dt.date(2024, 1, 3)},
        {"sale_id": "b", "qty": 2, "sold_on": dt.date(2024, 2, 3)},
        {"sale_id": "c", "qty": 2, "sold_on": dt.date(2024, 3, 3)},
        {"sale_id": "d", "qty": 9, "sold_on": None},
    )
    before = month_files(spark, store)
    asked = make.return_requests(
        spark, {"request_id": "1", "sale_id": "a", "qty": 2}, {"request_id": "2", "sale_id": "c", "qty": 2},
        {"request_id": "3", "sale_id": "d", "qty": 1},
    )
    sold = store.read().drop("month")
    day = ledger.apply_returns(make.products(spark, {}), sold, asked)
    expected = make.sorted_rows(day.sales)
    written = store.merge(changed=day.changed_sales, removed=day.removed_sales)
    assert written == [None, dt.date(2024, 1, 1), dt.date(2024, 3, 1)]
    assert make.sorted_rows(store.read().drop("month")) == expected
    after = month_files(spark, store)
    assert set(after) == {None, dt.date(2024, 1, 1), dt.date(2024, 2, 1)}
    february = dt.date(2024, 2, 1)
    assert after[february] == before[february] and after[None] != before[None]


def test_merge_again_gives_the_same(spark, tmp_path):
    store = new_store(spark, tmp_path, {"sale_id": "a", "qty": 5}, {"sale_id": "b", "qty": 1})
    added = make.sales(spark, {"sale_id": "n", "sold_on": dt.date(2025, 5, 5)})
    moved = make.sales(spark, {"sale_id": "a", "qty": 5, "sold_on": dt.date(2023, 1, 1)})
    gone = spark.createDataFrame([("b",), ("never stored",), (None,)], "sale_id string")
    for _ in range(2):
        store.merge(changed=moved, removed=gone, added=added)
        assert make.sorted_rows(store.read(), "sale_id", "month") == [
            ("a", dt.date(2023, 1, 1)), ("n", dt.date(2025, 5, 1)),
        ]
        assert [r.sale_id for r in store.find(gone.union(added.select("sale_id"))).collect()] == ["n"]
    assert store.merge() == [] and store.merge(removed=gone) == []


@pytest.mark.parametrize("bits", [16, 0.0001])
def test_found_rows_are_exact_and_few_files_are_opened(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr("tillbook.sources.store.BITS_PER_KEY", bits)
    rng = random.Random(4)
    sold = [
        {"sale_id": f"{rng.randrange(16**8):08x}", "sold_on": dt.date(2020 + i % 3, 1 + i % 12, 5)} for i in range(600)
    ]
    store = new_store(spark, tmp_path, *sold)
    ids = [sold[0]["sale_id"], sold[13]["sale_id"], sold[38]["sale_id"], "not there"]
    keys = spark.createDataFrame([(i,) for i in ids], "sale_id string")
    found = store.find(keys)
    assert sorted(r.sale_id for r in found.collect()) == sorted(ids[:3])
    files = store.files_of(keys)
    every = store.read().select(F.input_file_name()).distinct().count()
    assert 2 <= len(files) < every / 2
    opened = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert len(opened) <= len(files)
    assert store.files_of(keys.limit(0)) == [] and store.find(keys.limit(0)).count() == 0


def test_merge_prunes_by_month(spark, tmp_path):
    from tillbook.sources.store import in_months

    store = new_store(spark, tmp_path, {"sale_id": "a"}, {"sale_id": "b", "sold_on": dt.date(2020, 2, 2)})
    some = store.read().filter(in_months([dt.date(2020, 2, 1), None]))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan)
    assert [r.sale_id for r in some.collect()] == ["b"]
    assert schemas.TABLES["sales"].fieldNames() == store.schema.fieldNames()


def test_the_index_is_not_sorted_by_paths(spark, tmp_path, monkeypatch):
    """Aggregates of texts and bitmaps sort their rows: by number, not by month and path."""
    seen = []
    whole = replace_months
    monkeypatch.setattr("tillbook.sources.store.replace_months", lambda rows, *rest: seen.append(rows) or whole(rows, *rest))
    day = dt.date(2024, 1, 3)
    sold = [{"sale_id": i, "sold_on": day} for i in ("b", "a", None, "c")] + [{"sale_id": None, "sold_on": None}]
    store = new_store(spark, tmp_path, *sold)
    text = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" in text and not re.search(r"SortAggregate\(key=\[[^\]]*file", text)
    index = store._read_index().select("least", "most", "month").distinct().collect()
    assert [tuple(r) for r in index] == [("a", "c", dt.date(2024, 1, 1))]
    assert [r.sale_id for r in store.find(store.read().filter("sale_id = 'a' or sale_id is null")).collect()] == ["a"]
