"""Token-ID binary output (operator 1): training-order materialisation.

Texts are encoded, ended with an end token and cut into sequences of ``length`` ids. A keyed Feistel network over the
next power of four, walked until it falls into range, permutes 0..N-1 and gives sequence i its global slot. The slots
are cut into shards of ``shard_rows``; a shard's sequences lie behind each other in slot order with a fixed stride, so
slot s is at byte (s mod shard_rows) * stride of shard s div shard_rows, and a reader can stop and resume at any slot. A
shard is stored as rows of ``BLOCK_ROWS`` sequences, which executors write without a POSIX folder; each row says stride, width and
shard_rows, so a reader needs nothing but the folder.

Partitions are ranges of slots that are known before the shuffle (the slots are dense), so nothing is sampled and the
files lie in the order of the slots. A dense slot needs the number of all sequences, so the sequences are stored between
the two steps: every text is encoded once, the stored sequences are counted, and only they are shuffled, once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import bpe, ragged
from plotweave.llm.common import Scratch

#: Sequences in one stored block; a shard is a whole number of blocks, but for the last.
BLOCK_ROWS = 256
ROUNDS = 6

#: Partitions of the shuffle, at most; beyond, a partition holds several shards.
PARTITIONS = 100_000
#: Bytes of sequences that leave the encoder at a time.
CHUNK = 1 << 24

BLOCKS = "shard int, first_slot long, n int, stride int, width int, shard_rows int, payload binary, ids array<{id}>, parts array<int>, lengths array<int>"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 chosen by ``key``, applied to each index."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        with np.errstate(over="ignore"):
            for k in keys:
                mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def _cut(tokens: np.ndarray, length: int) -> np.ndarray:
    """Sequences of each row: its tokens and one end token."""
    return -(-(tokens + 1) // length)


def materialise(
    docs: DataFrame, tokenizer: str, path: str, length: int = 512, shard_rows: int = 4096, key: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> int:
    """Write the shards of ``docs`` to the table at ``path``; gives the number of sequences.

    A null or empty text is one sequence of one end token; the last sequence of a text is filled up with end tokens and
    its length kept. Ids are unsigned 16-bit little-endian if the vocabulary allows, else 32-bit. Every row is written,
    repeated ones too; only id and text are read, once. The sequences, not yet filled up, lie in a scratch table until the
    shards are written. A shard is sorted in one task, whose size is shard_rows * stride; a lost task or executor repeats
    its own part.
    """
    spark = docs.sparkSession
    vocabulary = bpe.load(tokenizer)
    end = vocabulary.specials.get("<|endoftext|>", vocabulary.size - 1)
    kind = np.dtype("<u2") if vocabulary.size <= 1 << 16 else np.dtype("<u4")
    stride = length * kind.itemsize
    held = spark.sparkContext.broadcast(vocabulary)
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()
    if shard_rows % BLOCK_ROWS:
        raise ValueError(f"shard_rows must be a multiple of {BLOCK_ROWS}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, origin, at = bpe.encoder(held.value, keep_ids=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(1))
            for a, b in ragged.blocks(offsets):
                n, ids = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = np.full(len(ids) + b - a, end, kind)
                flat[np.repeat(np.arange(b - a), n) + np.arange(len(ids))] = ids
                cut = _cut(n, length)
                row = np.repeat(np.arange(b - a), cut)
                part = np.arange(len(row)) - (np.cumsum(cut) - cut)[row]
                size = np.minimum(length, n[row] + 1 - part * length)
                bounds = np.concatenate([[0], np.cumsum(size)])
                step = max(1, CHUNK // stride)
                for x in range(0, len(row), step):
                    y = min(x + step, len(row))
                    places = ((bounds[x : y + 1] - bounds[x]) * kind.itemsize).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(a + row[x:y])),
                            pa.array(part[x:y].astype(np.int32)),
                            pa.array(size[x:y].astype(np.int32)),
                            pa.array(np.full(y - x, origin, np.int32)),
                            pa.array(at + np.arange(x, y)),
                            pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(places), pa.py_buffer(flat[bounds[x] : bounds[y]])]),
                        ],
                        names=["id", "part", "length", "origin", "place", "payload"],
                    )
                at += len(row)

    scratch = Scratch(spark, "token-sequences")
    try:
        stored = scratch.save(source.mapInArrow(encode, f"id {id_type}, part int, length int, origin int, place long, payload binary"), "rows")
        total, first = 0, {}
        for r in sorted(stored.groupBy("origin").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()):
            if r.n != r.last + 1:
                raise RuntimeError(f"partition {r.origin}: {r.n} sequences are stored, its last has number {r.last}")
            first[r.origin] = total
            total += r.n
        _write(stored, path, first, total, length, kind, end, shard_rows, key)
    finally:
        scratch.drop("rows")
    return total


def _write(stored: DataFrame, path: str, first: dict[int, int], total: int, length: int, kind: np.dtype, end: int, shard_rows: int, key: int) -> None:
    """Shards of the stored sequences. ``first``: the number of the first sequence of each partition they were made in."""
    spark, stride = stored.sparkSession, length * kind.itemsize
    begins = np.zeros(max(first, default=0) + 1, np.int64)
    begins[list(first)] = list(first.values())
    places = spark.sparkContext.broadcast(begins)

    @F.arrow_udf("long")
    def slot(origin: pa.Array, place: pa.Array) -> pa.Array:
        return pa.array(feistel(places.value[origin.to_numpy()] + place.to_numpy(), total, key))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        have = 0

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            slots = rows.column("slot").to_numpy()
            if int(slots[-1]) - int(slots[0]) != len(slots) - 1:
                raise RuntimeError("slots of a block do not follow each other")
            n, sizes, ids = len(slots), rows.column("length").to_numpy(), ragged.utf8(rows.column("payload"))[0].view(kind)
            flat = np.full(n * length, end, kind)
            flat[np.repeat(np.arange(n) * length - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slots[0]) // shard_rows], pa.int32()),
                    pa.array([int(slots[0])], pa.int64()),
                    pa.array([n], pa.int32()),
                    pa.array([stride], pa.int32()),
                    pa.array([kind.itemsize], pa.int32()),
                    pa.array([shard_rows], pa.int32()),
                    pa.array([flat.tobytes()], pa.binary()),
                    *(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(c)) for c in ("id", "part", "length")),
                ],
                names=["shard", "first_slot", "n", "stride", "width", "shard_rows", "payload", "ids", "parts", "lengths"],
            )

        for batch in batches:
            held_rows.append(batch)
            have += batch.num_rows
            if have < BLOCK_ROWS + 1:
                continue
            rows = pa.concat_batches(held_rows)
            edges = _edges(rows)
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                yield block(rows.slice(x, y - x))
            held_rows = [rows.slice(edges[-1])]
            have = rows.num_rows - edges[-1]
        if have:
            rows = pa.concat_batches(held_rows)
            edges = [*_edges(rows), rows.num_rows]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                yield block(rows.slice(x, y - x))

    rows = stored.select(slot("origin", "place").alias("slot"), "id", "part", "length", "payload")
    shards = max(1, -(-total // shard_rows))
    each = -(-shards // PARTITIONS)
    ranges = F.floor(F.col("slot") / (shard_rows * each)).cast("int")
    packed = rows.repartitionById(-(-shards // each), ranges).sortWithinPartitions("slot").mapInArrow(pack, BLOCKS.format(id=stored.schema["id"].dataType.simpleString()))
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _edges(rows: pa.RecordBatch) -> list[int]:
    """Where the blocks of rows in the order of their slots begin."""
    number = rows.column("slot").to_numpy() // BLOCK_ROWS
    return [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist()]


def read_blocks(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """Blocks from the one with ``from_slot`` on; the filter on shard and slot reaches the files."""
    blocks = spark.read.parquet(path)
    one = blocks.select("shard_rows").first() if from_slot else None
    return blocks.where((F.col("shard") >= from_slot // one.shard_rows) & (F.col("first_slot") > from_slot - BLOCK_ROWS)) if one else blocks


def sequences(blocks: DataFrame) -> DataFrame:
    """One row for each sequence in ``blocks``, read back: ``slot, shard, byte_offset, id, part, length, tokens_crc32``."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                shard, first, n, stride, shard_rows = (batch.column(c)[b].as_py() for c in ("shard", "first_slot", "n", "stride", "shard_rows"))
                payload, ids, parts, lengths, width = (batch.column(c)[b] for c in ("payload", "ids", "parts", "lengths", "width"))
                raw, width = memoryview(payload.as_buffer()), width.as_py()
                slot = first + np.arange(n)
                size = lengths.values.to_numpy()
                crc = [zlib.crc32(raw[i * stride : i * stride + int(size[i]) * width]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array([shard] * n, pa.int32()), pa.array((slot % shard_rows) * stride), ids.values, parts.values, lengths.values, pa.array(crc, pa.int64())],
                    names=["slot", "shard", "byte_offset", "id", "part", "length", "tokens_crc32"],
                )

    return blocks.select("shard", "first_slot", "n", "stride", "shard_rows", "width", "payload", "ids", "parts", "lengths").mapInArrow(run, f"slot long, shard int, byte_offset long, id {id_type}, part int, length int, tokens_crc32 long")
