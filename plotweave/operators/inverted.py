"""Approximate nearest neighbours by an inverted file: vectors in lists by their nearest coarse centre, few lists read a query.

Centres are fitted on a bounded sample (``SAMPLE`` rows by the order of their hashes); every row is indexed. The index is a
table with one folder a list, so a probe reads the folders of its lists only. Distances within the lists are exact, so the result
is short of the exact one only by neighbours in lists that were not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.operators.search import nearest_each

#: Rows on which centres are fitted, rounds of fitting, and rows of a list that one task compares.
SAMPLE, ROUNDS, SHARD = 20_000, 12, 50_000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)


def fit_centres(rows: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from rows drawn at random; a centre that loses its rows keeps its place."""
    lists = min(lists, len(rows))
    centres = rows[np.random.default_rng(seed).choice(len(rows), lists, replace=False)]
    for _ in range(ROUNDS if lists else 0):
        own = _squares(rows, centres).argmin(axis=1)
        n = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class InvertedFile:
    """An index under ``path``: ```centres`` (text) and ``rows`` (id, v, further columns, list)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = json.loads(spark.read.text(f"{path}/centres", wholetext=True).first()[0])
        self.centres, self.schema = np.array(held["centres"], float).reshape(held["lists"], -1) if held["lists"] else np.zeros((0, 0)), held["schema"]

    @classmethod
    def build(cls, table: DataFrame, path: str, lists: int | None = None, id_col: str = "id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> InvertedFile:
        """Index all rows whose vector is not null and as long as most; ``keep`` names columns for filters."""
        spark = table.sparkSession
        rows = table.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), *keep).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")
        usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (usual["dim"], usual["count"]) if usual else (0, 0)
        rows = rows.where(F.size("v") == dim)
        drawn = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
        sample = np.array([r.v for r in drawn], float).reshape(len(drawn), dim)
        centres = fit_centres(sample, lists or max(1, round(n**0.5)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list long"
        held = {"lists": len(centres), "centres": centres.tolist(), "schema": kinds}
        spark.createDataFrame([(json.dumps(held),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/centres")
        held = spark.sparkContext.broadcast(centres)

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(list=_squares(np.stack(frame["v"].to_numpy()), held.value).argmin(axis=1)) if len(frame) else frame.assign(list=[])

        rows.mapInPandas(place, kinds).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        """The indexed rows; the list is a folder's name, so its type is given."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id, q, list``: the lists whose centres are nearest to each query (columns query_id, query)."""
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("q")).where(F.size("q") == self.centres.shape[1])
        held = self.spark.sparkContext.broadcast(self.centres)

        def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    order = np.argsort(_squares(np.stack(frame["q"].to_numpy()), held.value), axis=1, kind="stable")[:, :probes]
                    yield frame.assign(list=[x.tolist() for x in order])

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.mapInPandas(pick, f"query_id {kind}, q array<double>, list array<long>").select("query_id", "q", F.explode("list").alias("list"))

    def nearest_each(self, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None) -> DataFrame:
        """``query_id, id, distance, rank``: the nearest rows (ties by id) in the lists that are read.

        Rows and queries meet by list; a long list is dealt to shards, each with the queries of the list, that keep their k nearest.
        """
        index = self.rows() if where is None else self.rows().where(where)
        sizes = index.groupBy("list").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
        rows = index.select("id", "v", "list").join(F.broadcast(sizes), "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"))
        asked = self.probes(queries, probes).join(F.broadcast(sizes), "list").select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        id_type, query_type = (d.schema[c].dataType.simpleString() for d, c in ((rows, "id"), (asked, "query_id")))

        def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(mine) and len(theirs):
                v, ids = np.stack(mine["v"].to_numpy()), mine["id"].to_numpy()
                for query, q in zip(theirs["query_id"], theirs["q"], strict=True):
                    d = np.square(v - np.asarray(q)).sum(axis=1)
                    few = np.lexsort((ids, d))[:k]
                    out += [(query, ids[i], d[i]) for i in few]
            return pd.DataFrame(out, columns=["query_id", "id", "distance"])

        found = rows.groupBy("list", "shard").cogroup(asked.groupBy("list", "shard")).applyInPandas(compare, f"query_id {query_type}, id {id_type}, distance double")
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        ranked = found.withColumn("rank", first).where(F.col("rank") <= k)
        return ranked.select("query_id", "id", "distance", "rank")

    def probes_for(self, table: DataFrame, queries: DataFrame, k: int, least: float = 0.9, id_col: str = "id", vector: str = "embedding") -> int:
        """The fewest probes, by doubling and halving, with which ``queries`` (a bounded sample) reach a recall of ``least``."""
        exact = nearest_each(table, queries, k, id_col, vector).select("query_id", "id", "distance").persist()
        low, high = 0, 1
        while high < len(self.centres) and recall(self.nearest_each(queries, k, high), exact).first()[0] < least:
            low, high = high, 2 * high
        while high - low > max(1, high // 8):
            middle = (low + high) // 2
            low, high = (low, middle) if recall(self.nearest_each(queries, k, middle), exact).first()[0] >= least else (middle, high)
        exact.unpersist()
        return min(high, len(self.centres))

    def compared(self, queries: DataFrame, probes: int = 8) -> DataFrame:
        """``query_id, compared``: the rows in the lists that a query reads."""
        sizes = self.rows().groupBy("list").agg(F.count("*").alias("n"))
        return self.probes(queries, probes).join(F.broadcast(sizes), "list").groupBy("query_id").agg(F.sum("n").alias("compared"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``recall``: the share of exact neighbours (query_id, id, distance) that were found, or others as near."""
    worst = exact.groupBy("query_id").agg(F.max("distance").alias("most"), F.count("*").alias("n"))
    hits = found.join(worst, "query_id").where(F.col("distance") <= F.col("most") * (1 + 1e-9)).groupBy("query_id").agg(F.count("*").alias("hits"))
    both = worst.join(hits, "query_id", "left").agg(F.sum(F.least("n", F.coalesce("hits", F.lit(0)))).alias("hits"), F.sum("n").alias("n"))
    return both.select(F.coalesce(F.col("hits") / F.col("n"), F.lit(1.0)).alias("recall"))
