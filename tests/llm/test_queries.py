"""Registered queries and the pipeline on the smallest given tables."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tillbook.llm import queries

SOURCE = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SOURCE}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SOURCE)
    con = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(con.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_gives_a_row_for_each_row(spark, name):
    table, key = {"op2": ("pages", "page_id"), "op8": ("embeddings", "vec_id")}.get(
        name.split("_")[0], ("documents", "doc_id")
    )
    found = queries.QUERIES[name](spark, SOURCE)
    ids = sorted(r[0] for r in spark.read.parquet(f"{SOURCE}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in found.select(key).distinct().collect()) == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SOURCE)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        assert after == before if name == "mixing" else len(after) > 0.5 * len(before)
        before = after
    packed = corpus_pipeline.run(spark, SOURCE)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before
