"""Nearest rows of many queries: against all distances, and the memory of a task."""

import tracemalloc

import numpy as np
import pytest

from plotweave.operators import search

ROWS = "id LONG, embedding ARRAY<DOUBLE>"


def by_all(rows, queries, k):
    out = []
    with np.errstate(all="ignore"):
        for q, x in queries:
            d = [(np.square(np.array(v) - np.array(x)).sum(), i) for i, v in rows if v is not None and None not in v and len(v) == len(x)]
            d.sort(key=lambda p: (np.isnan(p[0]), p[0] if not np.isnan(p[0]) else 0, p[1]))
            out += [(q, i, n) for n, (_, i) in enumerate(d[:k], 1)]
    return sorted(out)


def vectors(kind, rng):
    v = rng.integers(-3, 4, (400, 5)).astype(float)  # many ties
    if kind == "far":
        v = v * 1e-3 + 1e7
    if kind == "copies":
        v[rng.random(400) < 0.8] = 1.0
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(400), v, strict=True)]
    if kind == "odd":
        rows[:6] = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 5), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (1004, [1e200] * 5), (1005, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("kind", ["near", "far", "copies", "odd"])
def test_against_all_distances(spark, monkeypatch, kind):
    rows = vectors(kind, np.random.default_rng(5))
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    asked = [(i, v) for i, v in rows if v is not None and (i % 7 == 0 or i >= 1000) and None not in v]
    queries = spark.createDataFrame(asked, "query_id LONG, query ARRAY<DOUBLE>")
    want = by_all(rows, asked, 3)
    assert sorted((r.query_id, r.id, r["rank"]) for r in search.nearest_each(table, queries, 3).collect()) == want
    # and in products of a few rows and queries
    monkeypatch.setattr(search, "ROWS", 16)
    monkeypatch.setattr(search, "PRODUCTS", 16 * 7)
    monkeypatch.setattr(search, "NUMBERS", 100)
    asked, whole = ([(i, v) for i, v in x if v is not None and len(v) == 5 and None not in v] for x in (asked, rows))
    for k in (1, 3):
        nearest = search.Nearest(np.array([v for _, v in asked]), k)
        for at in range(0, len(whole), 150):
            nearest.meet(np.array([i for i, _ in whole[at : at + 150]]), np.array([v for _, v in whole[at : at + 150]]))
        assert len(nearest.found) == -(-len(asked) // 7)
        found = {}
        for q, _, i in nearest.found:
            for x, y in zip(q.tolist(), i.tolist(), strict=True):
                found.setdefault(asked[x][0], []).append(y)
        assert sorted((q, i, n) for q, ids in found.items() for n, i in enumerate(ids, 1)) == by_all(whole, asked, k)


def test_few_rows(spark):
    rows = [(1, [0.0]), (2, [1.0]), (3, []), (4, [])]
    table = spark.createDataFrame(rows, ROWS)
    queries = spark.createDataFrame([(9, [0.75]), (8, [])], "query_id LONG, query ARRAY<DOUBLE>")
    assert sorted((r.query_id, r.id, r.distance) for r in search.nearest_each(table, queries, 3).collect()) == [(8, 3, 0.0), (8, 4, 0.0), (9, 1, 0.5625), (9, 2, 0.0625)]
    assert search.nearest_each(table, queries.limit(0), 3).count() == 0


def test_memory_does_not_grow_with_queries_times_rows(spark):
    """6,000 queries by one Arrow batch are 480 MB as one product; half the rows are copies of one vector."""
    rng = np.random.default_rng(1)
    v = rng.random((10_000, 8))
    v[::2] = v[0]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ROWS)
    queries = table.where("id < 6000").selectExpr("id query_id", "embedding query")
    run = {}
    real = type(table).mapInArrow
    type(table).mapInArrow = lambda self, f, schema: run.setdefault("f", f) and real(self, f, schema)
    try:
        search.nearest_each(table, queries, 3)
    finally:
        type(table).mapInArrow = real
    batch = table.selectExpr("id", "embedding v").toArrow().combine_chunks().to_batches()[0]
    held = run["f"].__defaults__[0].value  # read before memory is counted
    assert held
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run["f"](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 3 * 6000 and most < 200e6
