"""Queries that SQL can express give the rows that DuckDB gives."""

import pytest

from plotweave.llm import queries
from tests.test_oracle import duck, rows  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    out = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, out.fetchall())


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
