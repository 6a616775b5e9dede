import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from plotweave.llm import centroids

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def by_integers(rows, k, rounds, dim, scale=256.0):
    """The rule with Python integers; rows are (id, vector)."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(now)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((str(i), c, long(d), long(sum(x for _, y, x in found if y == c)), long(total), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def result(df):
    return sorted(((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e8, 1e11])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(int(size))
    rows, c = np.floor(rng.normal(0, size, (300, 5))), np.floor(rng.normal(0, size, (7, 5)))
    rows[:50] = rows[50:100]
    rows[::17] *= 1000
    cluster, distance = centroids.nearest(rows, c)
    for row, n, d in zip(rows.tolist(), cluster.tolist(), distance.tolist(), strict=True):
        each = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, x, strict=True)) for x in c.tolist()]
        assert (d, n) == (min(each), each.index(min(each)))


def test_product_is_used_within_its_bound_only():
    near, far = np.full((1, 64), 2.0**21), np.full((1, 64), 2.0**22)
    assert centroids._fits(near, near, centroids.EXACT)[0] and not centroids._fits(far, far, centroids.EXACT)[0]


def test_sums_beyond_floats_are_exact():
    rows = np.array([[2.0**60, -1.0], [3.0, -(2.0**70)], [1.0, 1.0]])
    sums, n = centroids.cluster_sums(rows, np.array([1, 1, 0]), 3)
    assert sums.tolist() == [[1, 1], [2**60 + 3, -1 - 2**70], [0, 0]] and n.tolist() == [1, 2, 0]


@pytest.mark.parametrize("size", [0.2, 2e5, 3e9])
def test_same_as_integers(spark, size):
    rng = random.Random(5)
    rows = [(rng.randrange(60), [round(rng.gauss(rng.choice([-1, 1]), 1), 2) * size for _ in range(4)]) for _ in range(120)]
    rows += [rows[3], rows[3], (None, [0.5 * size] * 4), (7, None), (8, []), (9, [1.0] * 3), (10, [1.0] * 5), (11, [1.0, None, 1.0, 1.0]), (12, [1.0, float("nan"), 1.0, 1.0]), (13, [float("inf"), 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    assert result(centroids.cluster(table, k=6, rounds=5, dim=4)) == by_integers(rows, 6, 5, 4)


def test_all_alike_and_fewer_rows_than_centroids(spark):
    rows = [(i, [0.25, -0.5]) for i in range(5)]
    out = centroids.cluster(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), k=9, rounds=2, dim=2)
    assert result(out) == by_integers(rows, 9, 2, 2) and {r.cluster for r in out.collect()} == {0}


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(50)]
    table = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(2)
    whole = result(centroids.cluster(table, k=4, dim=3))
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 7)
    assert result(centroids.cluster(table, k=4, dim=3)) == whole


def test_distances_beyond_64_bits_are_null(spark):
    rows = [(i, [1e30 * (i % 3), 1.0]) for i in range(6)]
    out = centroids.cluster(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), k=1, rounds=1, dim=2).collect()
    assert {r.cluster for r in out} == {0} and any(r.distance is None for r in out)


def test_empty(spark):
    out = centroids.cluster(spark.createDataFrame([], SCHEMA), k=4)
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "cluster", "distance"]
