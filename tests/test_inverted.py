import numpy as np
from pyspark.sql import functions as F

from plotweave.operators import inverted, search
from plotweave.plans import temporal

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(i, v, i % 3) for i, v in rows], "id LONG, embedding ARRAY<DOUBLE>, era INT")


def clustered(rng, n=1500, groups=30, dim=8):
    centres = rng.normal(0, 10, (groups, dim))
    return [(i, (centres[i % groups] + rng.normal(0, 0.3, dim)).tolist()) for i in range(n)]


def asked(df, every=50):
    return df.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def test_all_lists_give_the_exact_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SHARD", 20)
    rng = np.random.default_rng(1)
    rows = clustered(rng, 300) + [(1000 + i, [1.0] * 8) for i in range(30)] + [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 8)]
    df = table(spark, rows)
    index = inverted.InvertedFile.build(df, f"file://{tmp_path}/a", lists=7)
    key = lambda d: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in d.collect())
    good = df.where("id < 2000")
    assert key(index.nearest_each(asked(good), 5, len(index.centres))) == key(search.nearest_each(good, asked(good), 5))


def test_few_lists_of_clustered_rows(spark, tmp_path):
    df = table(spark, clustered(np.random.default_rng(2)))
    index = inverted.InvertedFile.build(df, f"file://{tmp_path}/b", lists=30, keep=("era",))
    exact = search.nearest_each(df, asked(df), 10)
    assert inverted.recall(index.nearest_each(asked(df), 10, 2), exact).first()[0] >= 0.95
    assert index.compared(asked(df), 2).agg(F.max("compared")).first()[0] < 0.2 * 1500
    assert index.probes_for(df, asked(df, 200), 10) <= 3
    assert {r.id % 3 for r in index.nearest_each(asked(df), 10, 2, F.col("era") == 1).collect()} == {1}


def test_the_query_reaches_its_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    found = temporal.approximate_topk_each(spark, SF)
    exact = search.nearest_each(df, asked(df, 20), 10)
    assert found.count() == exact.count() and inverted.recall(found, exact).first()[0] >= 0.9


def test_empty(spark, tmp_path):
    index = inverted.InvertedFile.build(table(spark, []), f"file://{tmp_path}/c")
    assert index.nearest_each(asked(table(spark, [(1, [1.0])]), 1), 3).count() == 0
