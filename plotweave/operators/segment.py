"""Text segmentation into overlapping chunks under a token budget.

Texts that fit are passed on by a native branch; only the others go to Python, one Arrow batch at a time. The embedder
is any function from a list of strings to a matrix; the default hashes words, which needs no model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import text as T
from plotweave.functions import vectors

# Defaults of the segmenter.
MAX_TOKENS, OVERLAP, THRESHOLD = 2500, 0.20, 0.45
DIMENSIONS = 64

Embedder = Callable[[list[str]], np.ndarray]


def hash_embed(texts: list[str]) -> np.ndarray:
    """Word counts hashed into ``DIMENSIONS`` places."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, zlib.crc32(w.encode()) % DIMENSIONS] += 1
    return out


def tokens(text: str) -> int:
    return int(len(text.split()) * T.TOKENS_PER_WORD)


def split_blocks(text: str) -> list[str]:
    unix = re.sub("\r\n?", "\n", text)
    for pattern in ("\n{2,}", "\n"):
        found = [b.strip() for b in re.split(pattern, unix) if b.strip()]
        if len(found) > 1:
            break
    return found


def breakpoints(blocks: list[str], embed: Embedder, threshold: float) -> list[bool]:
    """Whether a cut follows each block: where it and the next one are less similar than ``threshold``."""
    if len(blocks) < 2:
        return [False] * len(blocks)
    m = np.asarray(embed(blocks), float)
    size = np.linalg.norm(m, axis=1)
    scale = size[:-1] * size[1:]
    similar = np.divide((m[:-1] * m[1:]).sum(axis=1), scale, out=np.zeros(len(scale)), where=scale > vectors.EPSILON)
    return [*(similar < threshold).tolist(), False]


def pack(parts: list[list[str]], budget: int) -> list[list[str]]:
    """Neighbouring lists joined as long as the words of the result stay within the budget."""
    out: list[list[str]] = []
    for part in parts:
        if out and tokens("\n\n".join([*out[-1], *part])) <= budget:
            out[-1] = [*out[-1], *part]
        else:
            out.append(list(part))
    return out


def segment(text: str, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP, threshold: float = THRESHOLD, embed: Embedder = hash_embed) -> list[str]:
    """Chunks of a text: itself if it fits or has one block, else groups of blocks with the tail of the chunk before."""
    if tokens(text) <= max_tokens or len(blocks := split_blocks(text)) <= 1:
        return [text]
    groups: list[list[str]] = [[]]
    for block, cut in zip(blocks, breakpoints(blocks, embed, threshold), strict=True):
        groups[-1].append(block)
        if cut:
            groups.append([])
    fine = [f for g in pack([g for g in groups if g], max_tokens) for f in (pack([[b] for b in g], max_tokens) if tokens("\n\n".join(g)) > max_tokens else [g])]
    chunks = ["\n\n".join(f) for f in fine]
    tail = max(1, int(int(max_tokens * overlap) / T.TOKENS_PER_WORD))
    return [c if not i else " ".join(chunks[i - 1].split()[-tail:]) + "\n\n" + c for i, c in enumerate(chunks)]


def segment_texts(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP, threshold: float = THRESHOLD, embed: Embedder = hash_embed) -> DataFrame:
    """``id, idx, total, chunk``: one row per chunk. A null text counts as empty and is one empty chunk."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = source.withColumn("fits", T.estimate_tokens(F.col("text")) <= max_tokens)
    small = sized.where("fits").select("id", F.lit(0).alias("idx"), F.lit(1).alias("total"), F.col("text").alias("chunk"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, len(c), x) for i, t in zip(frame["id"], frame["text"], strict=True) for c in [segment(t, max_tokens, overlap, threshold, embed)] for k, x in enumerate(c)]
            yield pd.DataFrame(rows, columns=["id", "idx", "total", "chunk"])

    large = sized.where("NOT fits").select("id", "text").mapInPandas(cut, f"id {source.schema['id'].dataType.simpleString()}, idx int, total int, chunk string")
    return small.unionByName(large)


def block_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, block``: the blocks of each text as rows."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(T.blocks(F.col(text_col))).alias("pos", "block"))


def adjacent_similarity(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Each row with the cosine of its vector and the next one's within ``key``; null for the last."""
    ahead = F.lead(vector).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("next", ahead).withColumn("similarity", F.when(F.col("next").isNotNull(), vectors.cosine(F.col(vector), F.col("next")))).drop("next")


def group_at_breaks(rows: DataFrame, key: str, order: str, similarity: str, threshold: float = THRESHOLD) -> DataFrame:
    """Each row with its group: the number of cuts (similarity to the next below ``threshold``) before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("grp", F.coalesce(F.sum(F.when(F.col(similarity) < threshold, 1).otherwise(0)).over(before), F.lit(0)))


def overlap_tail(rows: DataFrame, key: str, order: str, chunk: str, n: int) -> DataFrame:
    """Each chunk with the last ``n`` words of the one before in front."""
    w = T.words(F.lag(chunk).over(Window.partitionBy(key).orderBy(order)))
    tail = F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " ")
    return rows.withColumn("overlapped", F.when(w.isNull(), F.col(chunk)).otherwise(F.concat(tail, F.lit("\n\n"), F.col(chunk))))


def next_chunks(chunks: DataFrame, key: str, order: str, id_col: str) -> DataFrame:
    """Links ``from_id, to_id`` from each chunk to the next one of its file."""
    ahead = F.lead(id_col).over(Window.partitionBy(key).orderBy(order))
    return chunks.select(F.col(id_col).alias("from_id"), ahead.alias("to_id")).where("to_id IS NOT NULL")
