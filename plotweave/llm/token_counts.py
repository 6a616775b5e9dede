"""Token counts (operator 8): rank-synchronous array merging over batched pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plotweave.llm import bpe, ragged


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, as the file's own library would count.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are one token each. Every row gives one
    row, repeated or null ids included; other columns are not read, so their names cannot clash. There is no shuffle;
    a worker holds one block of texts and at most ``bpe.REMEMBER`` distinct pre-tokens.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe.load(tokenizer))
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary.value, keep_ids=False)
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(1))
            parts = [np.zeros(0, np.int64)]
            for at, to in ragged.blocks(offsets):
                part = offsets[at : to + 1]
                parts.append(encoder.encode(data[part[0] : part[-1]], part - part[0])[0])
            n = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
