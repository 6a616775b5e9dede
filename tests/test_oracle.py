"""Every query that has SQL gives the rows that DuckDB gives."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from plotweave.plans import catalogue

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    out = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = rows(columns, out.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
    assert sum(got.values()) > 0
