from __future__ import annotations

import os

import duckdb
import pytest

from tallyweave import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    found = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_whole_tables(spark, duck, sf):
    live = duck.execute(catalogue.ORACLE_SQL["status_counts"]).fetchall()
    assert catalogue.QUERIES["history_before"](spark, sf).count() == sum(n for _, n in live)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    numbers = {r.doc_id: r.number for r in catalogue.QUERIES["norm_number"](spark, sf).collect()}
    assert len(numbers) == docs.count() and max(map(len, numbers.values())) > 40
