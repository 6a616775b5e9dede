"""SQL names for the library's functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plotweave.functions import similarity_batch
from plotweave.functions import text as T

# Native expressions as SQL functions, so that a query that names them keeps its generated code.
NATIVE = {
    "estimate_tokens": "CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS INT RETURN CAST(floor(size(filter(split(t, '(?U)\\\\s+'), w -> w <> '')) * 1.35D) AS INT)",
    "null_if_blank": "CREATE OR REPLACE TEMPORARY FUNCTION null_if_blank(t STRING) RETURNS STRING RETURN CASE WHEN t RLIKE '(?U)\\\\S' THEN t END",
}


def _names() -> list[str]:
    slug = "regexp_replace(regexp_replace(normalize_name(t), '[^a-z0-9]+', '-'), '^-+|-+$', '')"
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_name(t STRING) RETURNS STRING RETURN {T.normalize_sql('t')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION slugify(t STRING) RETURNS STRING RETURN {slug}",
    ]


def register(spark: SparkSession) -> None:
    """Register ``normalize_name``, ``slugify``, ``estimate_tokens``, ``null_if_blank``, ``fuzz_ratio``, ``wratio``,
    ``coverage``, ``embed``, and the table functions ``segment_text`` (one text) and ``segment_table``.

    ``segment_table(TABLE(SELECT id, text ...), max_tokens, overlap)`` takes the first two columns of a table, an Arrow batch at a
    time, and gives ``id, idx, total, chunk`` with the id as text; ``PARTITION BY`` may follow the table. A null text is one empty chunk.
    """
    from plotweave.operators.segment import hash_embed, segment

    for ddl in (*NATIVE.values(), *_names()):
        spark.sql(ddl)

    for name, function in (("fuzz_ratio", similarity_batch.ratio), ("wratio", similarity_batch.weighted), ("coverage", similarity_batch.coverage)):
        spark.udf.register(name, similarity_batch.scores(function))

    @F.udtf(returnType="idx int, total int, chunk string")
    class SegmentText:
        def eval(self, text: str, max_tokens: int, overlap: float):
            chunks = segment(text or "", max_tokens, overlap)
            for i, chunk in enumerate(chunks):
                yield i, len(chunks), chunk

    spark.udtf.register("segment_text", SegmentText)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(hash_embed([t or "" for t in texts]), "float32")), index=texts.index, dtype="object")

    spark.udf.register("embed", embed)

    @F.arrow_udtf(returnType="id string, idx int, total int, chunk string")
    class SegmentTable:
        def eval(self, rows: pa.RecordBatch, max_tokens: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
            if not rows.num_rows:
                return
            most, share = max_tokens[0].as_py(), overlap[0].as_py()
            ids = rows.column(0).cast(pa.string()).to_pylist()
            found = [(i, n, len(c), x) for i, t in zip(ids, rows.column(1).to_pylist(), strict=True) for c in [segment(t or "", most, share)] for n, x in enumerate(c)]
            columns = list(zip(*found, strict=True))
            kinds = {"id": pa.string(), "idx": pa.int32(), "total": pa.int32(), "chunk": pa.string()}
            yield pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)})

    spark.udtf.register("segment_table", SegmentTable)
