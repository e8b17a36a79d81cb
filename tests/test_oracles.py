"""Every query against its SQL in DuckDB, on the smallest given tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from tillbook.plans.oracles import all_oracles
from tillbook.plans.registry import all_queries

SOURCE = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem".split()
QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SOURCE}/{table}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, (float, Decimal)):
            return f"{float(v):.6f}"
        return v

    return sorted(
        (tuple(value(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, duck):
    df = QUERIES[name](spark, SOURCE)
    con = duck.execute(ORACLES[name])
    names = [column[0] for column in con.description]
    expected = con.fetchall()
    actual = df.collect()
    assert sorted(df.columns) == sorted(names)
    assert expected, "an oracle without rows checks nothing"
    assert canonical(actual, df.columns) == canonical(expected, names)
