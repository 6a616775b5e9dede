"""Centroid clustering (operator 13): exact integer k-means by blocked matrix products.

Vectors become integers (``floor(scale * x)``), kept as float64, which holds each of them exactly. They are stored once, in
blocks of rows. A round hands every block the centroids, finds the nearest by |x|^2 - 2x.c + |c|^2 with one matrix product
a block, and combines the sums of the clusters with ``treeAggregate``; the driver holds the centroids only.

All values of a product are integers, so it is exact while none of its partial sums reaches 2^53. That is proved for each
row from its largest component and the centroids' (``_fits``); other rows are computed with integers: 64-bit ones while
these cannot overflow, Python's beyond. Sums of clusters are Python integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plotweave.llm.common import Scratch

#: Rows that are multiplied at a time.
BLOCK_ROWS = 4096
#: Sums of products stay below these: exact in float64, no overflow in 64-bit integers.
EXACT, LONG = 2.0**53, 2.0**62


def usable(vector, dim: int, scale: float):
    """Whether a vector has ``dim`` components, none of them null, infinite (scaled, too) or NaN."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(scale)) != F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector.cast("array<double>"), finite), F.lit(False))


def _fits(rows: np.ndarray, centroids: np.ndarray, limit: float) -> np.ndarray:
    """Rows for which no partial sum of |x|^2 - 2x.c + |c|^2 reaches ``limit``: (|x| + |c|)^2 in the worst case, by largest components.

    Its factor of 2 more than covers the rounding of the bound itself.
    """
    most = np.abs(rows).max(axis=1, initial=0) + np.abs(centroids).max(initial=0)
    with np.errstate(over="ignore"):
        return 2.0 * rows.shape[1] * most * most < limit


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest) and the squared distance (object: exact integers) of each row.

    Both hold integers, as float64.
    """
    cluster, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    fast = _fits(rows, centroids, EXACT)
    if fast.any():
        x = rows[fast]
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
        best = d.argmin(axis=1)
        cluster[fast], distance[fast] = best, d[np.arange(len(d)), best].astype(np.int64)
    for i in np.flatnonzero(~fast).tolist():
        kind = np.int64 if _fits(rows[i : i + 1], centroids, LONG)[0] else object
        gap = _integers(centroids, kind) - _integers(rows[i : i + 1], kind)
        each = (gap * gap).sum(axis=1).tolist()
        cluster[i] = best = min(range(len(each)), key=each.__getitem__)
        distance[i] = int(each[best])
    return cluster, distance


def _integers(values: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)
    return values.astype(kind)


def cluster_sums(rows: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (Python integers) of the rows of each cluster, and their counts."""
    n = np.bincount(cluster, minlength=k)
    if len(rows) * np.abs(rows).max(initial=0) < EXACT:
        member = np.zeros((k, len(rows)))
        member[cluster, np.arange(len(rows))] = 1.0
        return (member @ rows).astype(np.int64).astype(object), n.astype(object)
    sums = np.zeros((k, rows.shape[1]), object)
    np.add.at(sums, cluster, _integers(rows, object))
    return sums, n.astype(object)


@dataclass
class Clusters:
    """Final centroids (exact integers), and the squared distances summed over each cluster."""

    centroids: list[list[int]]
    inertia: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _blocks(vectors: DataFrame, scale: float) -> DataFrame:
    """``ids, x``: blocks of up to BLOCK_ROWS rows of ``vectors`` (id, v); x is their integers as float64 bytes, ids an Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", part.column(0).type)])) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([part.column(0)], names=["id"]))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return vectors.mapInArrow(pack, "ids binary, x binary")


def _as_floats(centroids: list[list[int]], dim: int) -> np.ndarray:
    """Integers as float64; a mean of integers beyond 2^53 may have no such form, and then the exact path needs the integers."""
    return np.array([[float(x) for x in c] for c in centroids]).reshape(-1, dim)


def _exact(centroids: list[list[int]]) -> bool:
    return all(int(float(x)) == x for c in centroids for x in c)


def assign(rows: np.ndarray, centroids: list[list[int]], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for centroids of any size."""
    if _exact(centroids):
        return nearest(rows, _as_floats(centroids, dim))
    c = np.array(centroids, object)
    cluster, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    for i, row in enumerate(_integers(rows, object)):
        each = ((c - row) ** 2).sum(axis=1).tolist()
        cluster[i] = best = min(range(len(each)), key=each.__getitem__)
        distance[i] = each[best]
    return cluster, distance


def fit(blocks: DataFrame, start: list[list[int]], rounds: int, dim: int, depth: int = 2) -> Clusters:
    """``rounds`` rounds from ``start``; then the distances to the centroids that come out."""
    context = blocks.sparkSession.sparkContext
    k, centroids = len(start), start
    data = blocks.select("x").rdd.map(lambda r: np.frombuffer(r.x, np.float64).reshape(-1, dim))

    def totals(now, measure: bool):
        held = context.broadcast(now)

        def add(acc, rows):
            cluster, distance = assign(rows, held.value, dim)
            if measure:
                found = np.zeros(k, object)
                np.add.at(found, cluster, distance)
                made = (found, np.zeros(k, object))
            else:
                made = cluster_sums(rows, cluster, k)
            return merge(acc, made)

        def merge(a, b):
            return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])

        out = data.treeAggregate(None, add, merge, depth)
        held.unpersist()
        return out

    for _ in range(rounds):
        found = totals(centroids, False)
        if found is None:
            break
        sums, n = found
        centroids = [[int(s) // int(m) for s in row] if m else before for row, m, before in zip(sums, n, centroids, strict=True)]
    found = totals(centroids, True)
    return Clusters(centroids, [0] * k if found is None else [int(x) for x in found[0]])


def cluster(
    vectors: DataFrame, k: int, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256, centroid array<string>`` for each usable vector.

    A vector is used if it has ``dim`` components and none is null, NaN or infinite (also once it is scaled); its components become
    ``floor(scale * x)``. Centroids 0, 1, ... start as the ``k`` used vectors with the smallest sha256 of ``seed:id`` (hex; a null
    id counts as empty; of rows that repeat an id the vector that comes first), or as many as there are. A round
    assigns every vector to the nearest centroid (squared Euclidean distance, ties: the smaller number) and replaces each
    centroid that has vectors by the floor of their mean, exactly. Without a usable vector the result is empty. Each row
    gives one row, rows that repeat an id too; only the two columns are read, so the names of others cannot clash. A
    distance or sum beyond 64 bits is null; it is exact where it decides.

    Work: rows * k * dim a round. The driver holds k centroids and k sums, a task one block of rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    good = vectors.where(usable(F.col(vector_col), dim, scale)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = good.withColumn("__first", first).orderBy("__first", "v").limit(k).select("v").collect()  # k rows
    start = [[int(x) for x in np.floor(scale * np.array(r.v)).tolist()] for r in chosen]
    id_type = good.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<string>").fields])
    if not start:
        return spark.createDataFrame([], schema)
    blocks = scratch.save(_blocks(good, scale), "blocks")
    found = fit(blocks, start, rounds, dim)
    digests, total, id_arrow = found.digests(), sum(found.inertia), to_arrow_type(id_type)
    names = [f.name for f in schema.fields]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = lambda values: pa.array([x if -(1 << 63) <= x < 1 << 63 else None for x in values], pa.int64())
        shown, centroids = pa.array(digests), pa.array([[str(x) for x in c] for c in found.centroids], pa.list_(pa.string()))
        for batch in batches:
            for ids, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = pa.ipc.open_stream(ids).read_all()["id"].combine_chunks().cast(id_arrow)
                number, distance = assign(np.frombuffer(x, np.float64).reshape(-1, dim), found.centroids, dim)
                at = pa.array(number)
                columns = [mine, pa.array(number.astype(np.int32)), long(map(int, distance)), long(found.inertia).take(at), long([total] * len(number)), shown.take(at), centroids.take(at)]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    return blocks.mapInArrow(tell, schema)
