"""CSV read in byte ranges gives what one task reads."""

from __future__ import annotations

import random

import pytest

from tillbook.sources import export_table, read_export
from tillbook.sources.exports import CSV_CELLS
from tillbook.sources.ranges import read_csv_ranges

SCHEMA = "id long, note string, other string"
PIECES = ['"', ",", "\n", "\r\n", " ", "a", "bc", "\\N x", "ü日", '""', "\n\n"]


@pytest.fixture(params=["300", "3000", "128m"])
def split(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield request.param
    for name in names:
        spark.conf.unset(name)


def rows():
    rng = random.Random(3)

    def cell(most):
        return rng.choice([None, "", "plain", "".join(rng.choices(PIECES, k=rng.randrange(1, most)))])

    # cells longer than several ranges, and runs of rows without quotes
    return [(k, cell(2000 if k % 97 == 0 else 8), "x" if k % 300 > 150 else cell(5)) for k in range(900)]


def test_ranges_give_what_one_task_reads(spark, tmp_path, split):
    made = rows()
    path = str(tmp_path / "t")
    export_table(spark.createDataFrame(made, SCHEMA).repartition(2), path, "csv")
    schema = spark.createDataFrame([], SCHEMA).schema
    found = read_export(spark, path, schema, "csv", ranges=True)
    assert found.schema == schema
    assert sorted(map(tuple, found.collect())) == made
    if split == "300":
        assert spark.read.text(path).rdd.getNumPartitions() > 50


def test_beyond_the_bound_files_are_read_whole(spark, tmp_path):
    made = rows()
    path = str(tmp_path / "t")
    export_table(spark.createDataFrame(made, SCHEMA).coalesce(1), path, "csv")
    schema = spark.createDataFrame([], SCHEMA).schema
    found = read_csv_ranges(spark, path, schema, {"emptyValue": "", **CSV_CELLS}, most_open=-1)
    assert sorted(map(tuple, found.collect())) == made


def test_empty_table_and_crlf(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    path = str(tmp_path / "t")
    export_table(spark.createDataFrame([], SCHEMA), path, "csv")
    assert read_export(spark, path, schema, "csv", ranges=True).collect() == []
    (tmp_path / "c.csv").write_bytes(b'id,note,other\r\n1,"a\r\nb",c\r\n\r\n2,d,"e"\r\n')
    found = read_export(spark, str(tmp_path / "c.csv"), schema, "csv", ranges=True).collect()
    assert sorted(map(tuple, found)) == [(1, "a\r\nb", "c"), (2, "d", "e")]
