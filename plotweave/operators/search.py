"""Exact nearest-neighbour search with metadata filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import vectors
from plotweave.operators.segment import Embedder, hash_embed


def embed(text: Column, embedder: Embedder = hash_embed) -> Column:
    """Vectors of texts (null as empty), by any function from a list of strings to a matrix, per Arrow batch."""

    @F.pandas_udf("array<float>")
    def column(texts: pd.Series) -> pd.Series:
        found = np.asarray(embedder([t or "" for t in texts]), dtype="float32")
        return pd.Series([row for row in found], index=texts.index, dtype="object")

    return column(text)


def metadata_filter(era: str | None = None, characters: list[str] | None = None) -> Column:
    """All given clauses: the era, and each character in the array ``characters``."""
    out = F.lit(True) if era is None else F.col("era") == era
    for c in characters or []:
        out = out & F.array_contains("characters", c)
    return out


def nearest(table: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to ``query`` by squared distance, ties by id; a top-k on each partition, then on their tops."""
    rows = table if where is None else table.where(where)
    scored = rows.withColumn("distance", vectors.squared_distance(F.col(vector), F.lit([float(x) for x in query])))
    return scored.orderBy("distance", id_col).limit(k)


#: Bytes of query vectors that are broadcast; more of them meet the rows in several blocks.
QUERY_BYTES = 1 << 25
#: Rows and products (rows by queries) of one matrix product, and numbers in the vectors of pairs measured together.
ROWS, PRODUCTS, NUMBERS = 1 << 11, 1 << 21, 1 << 22


def _vectors(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), width)


class Nearest:
    """The ``k`` rows nearest to each of some queries (a matrix) among those met so far, ties by id.

    A product of at most ``PRODUCTS`` numbers tells which pairs can count; it is not exact, so these are measured. Memory is
    that of a product and of k rows a query, however many queries and rows meet.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.squares = np.square(queries).sum(axis=1)
        self.left = np.column_stack([-2 * queries, np.ones(len(queries))])
        #: The k-th distance of each query; the found rows (query, distance, id) by blocks of queries.
        self.worst = np.full(len(queries), np.inf)
        step = max(1, PRODUCTS // ROWS)
        self.blocks = [(at, min(at + step, len(queries))) for at in range(0, len(queries), step)]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(self.blocks)

    @np.errstate(over="ignore", invalid="ignore")
    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        if len(v) > self.k and v.shape[1]:  # of equal vectors only those of the smallest ids can count
            _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
            order = np.lexsort((ids, same))
            first = np.flatnonzero(np.diff(same[order], prepend=-1))
            kept = np.sort(order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < self.k])
            ids, v = ids[kept], v[kept]
        for at in range(0, len(v), ROWS):
            some, mine = v[at : at + ROWS], ids[at : at + ROWS]
            squares = np.square(some).sum(axis=1)
            right, size = np.column_stack([some, squares]).T, squares.max()
            for n, (low, high) in enumerate(self.blocks):
                near = self.left[low:high] @ right
                # what rounding can make of the product, and of the sum that is measured
                slack = 8 * (v.shape[1] + 8) * np.finfo(float).eps * (self.squares[low:high] + size)
                cut = self.worst[low:high] - self.squares[low:high] + slack
                if len(some) > self.k:
                    far = np.flatnonzero(~np.isfinite(cut))
                    cut[far] = np.partition(near[far], self.k - 1, axis=1)[:, self.k - 1] + slack[far]
                held = ~(near > cut[:, None])  # what is no number is measured
                if len(some) > self.k and np.count_nonzero(held) > 8 * self.k * (high - low):
                    held &= ~(near > (np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + slack)[:, None])
                q, r = np.nonzero(held)
                step = max(1, NUMBERS // max(1, v.shape[1]))
                for pairs in range(0, len(q), step):
                    i, j = q[pairs : pairs + step] + low, r[pairs : pairs + step]
                    self._keep(n, i, np.square(some[j] - self.queries[i]).sum(axis=1), mine[j])

    def _keep(self, block: int, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        if self.found[block] is not None:
            q, d, i = (np.concatenate(x) for x in zip(self.found[block], (q, d, i), strict=True))
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        last = rank == self.k - 1
        self.worst[q[last]] = d[last]
        kept = rank < self.k
        self.found[block] = q[kept], d[kept], i[kept]


def nearest_each(table: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """``query_id, id, distance, rank`` for every query (columns query_id, query), ties by id.

    The stated queries meet all rows: a block of queries of at most ``QUERY_BYTES`` is broadcast, matrix products of a fixed
    size find the pairs to measure, and each task keeps k rows for each query, so only those are shuffled. Rows whose vector
    is null, has a null in it or is of another length than the query are no neighbours.
    """
    spark = table.sparkSession
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    source = table.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(whole("v"))
    id_type = source.schema["id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("q")).where(whole("q"))
    query_type = asked.schema["query_id"].dataType.simpleString()
    size = asked.agg(F.coalesce(F.sum(F.size("q").cast("long") * 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow().combine_chunks()
        sizes = pc.list_value_length(rows["q"]).to_numpy()
        parts = {int(w): rows.filter(pa.array(sizes == w)).combine_chunks() for w in np.unique(sizes)}
        held = spark.sparkContext.broadcast({w: (part["query_id"].combine_chunks(), _vectors(part["q"].combine_chunks(), w)) for w, part in parts.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best, kind = {w: Nearest(matrix, k) for w, (_, matrix) in held.value.items()}, None
            for batch in batches:
                kind = batch.schema.field("id").type
                widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for width, nearest in best.items():
                    some = batch.filter(pa.array(widths == width))
                    if some.num_rows:
                        nearest.meet(some.column(0).to_numpy(zero_copy_only=False), _vectors(some.column(1), width))
            for width, nearest in best.items():
                for found in nearest.found:
                    if found is not None:
                        q, d, i = found
                        yield pa.RecordBatch.from_arrays([held.value[width][0].take(pa.array(q)), pa.array(i, kind), pa.array(d, pa.float64())], names=["query_id", "id", "distance"])

        part = source.mapInArrow(run, f"query_id {query_type}, id {id_type}, distance double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def related_by_names(table: DataFrame, names: list[str], place: str | None, own_id, k: int = 10, embedder: Embedder = hash_embed) -> DataFrame:
    """The scenes related to one by the names of its people and its place: their words are the query."""
    query = " ".join([*names, *([place] if place else [])])
    return related(table, [float(x) for x in np.asarray(embedder([query]))[0]], own_id, k)


def with_summaries(hits: DataFrame, summaries: DataFrame, id_col: str = "id", scene_col: str = "scene_id") -> DataFrame:
    """Hits joined with the summaries of their scenes, nearest first; a hit without a scene goes."""
    return hits.select(F.col(id_col).alias(scene_col), "distance").join(summaries, scene_col).orderBy("distance", scene_col)


def related(table: DataFrame, query: list[float], own_id, k: int = 10, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows other than the asking one: one more is fetched, and it is dropped."""
    return nearest(table, query, k + 1, id_col=id_col, vector=vector).where(F.col(id_col) != F.lit(own_id)).orderBy("distance", id_col).limit(k)
