"""Exact dedup (operator 4): a log-structured merge index of text digests, with DataFrame functions only.

Rows are dealt to memtables of bounded size. A memtable is flushed as a run: its digests in order, each with its
smallest and largest id and its row count, in Parquet files with a Bloom filter on the digest. Compaction merges
``FAN_IN`` runs into one, level by level, until one run is left. A filter over its repeated digests is probed by every
row: one that it does not hold is its own group, without a join. A filter over the ids of the hits picks the rows whose
texts are worth moving; those are compared byte for byte, as the set of texts of a digest, which has one member unless
digests collide; equal texts of a task move as one, so a hot group is no hot task. Texts whose digests agree but whose
bytes do not are regrouped by their bytes. Filters have ``FILTER_LOAD`` bits a value; where
that is more than ``FILTER_BYTES``, joins take their place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import Scratch, join_hot

#: Rows in a memtable, on average.
MEMTABLE_ROWS = 1 << 15
#: Runs that one compaction merges.
FAN_IN = 16
#: Bits of a filter for each value in it, and the size up to which it is broadcast.
FILTER_LOAD, FILTER_BYTES = 16, 1 << 25

_BUCKET_BITS = 1 << 15  # of Spark's bitmap functions

RUN_FILTERS = {"parquet.bloom.filter.enabled#digest": "true"}


def normal(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null as empty. In ASCII text that is ``lower``, which is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _merge(rows: DataFrame, run: Column) -> DataFrame:
    """Rows of equal run and digest as one; sums and extremes combine before the shuffle."""
    return rows.groupBy(run.alias("run"), "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


class DigestIndex:
    """Runs of (run, digest, low, high, n) in the shared folder; ``compact`` leaves one."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.level, self.count = scratch, 0, 0
        self.runs: DataFrame | None = None

    def _write(self, runs: DataFrame, name: str) -> DataFrame:
        return self.scratch.save(runs.sortWithinPartitions("run", "digest"), name, **RUN_FILTERS)

    def flush(self, entries: DataFrame, memtables: int) -> None:
        """Flush rows (digest, id) as ``memtables`` runs of level 0."""
        memtable = F.pmod(F.xxhash64("digest", "id"), F.lit(memtables))
        self.runs = self._write(_merge(entries.select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n"), memtable.alias("run")), F.col("run")), "level-0")
        self.count = memtables

    def compact(self) -> DataFrame:
        """Merge until one run is left, and return it."""
        while self.count > 1:
            merged = self._write(_merge(self.runs, F.floor(F.col("run") / FAN_IN)), f"level-{self.level + 1}")
            self.scratch.drop(f"level-{self.level}")
            self.runs, self.level, self.count = merged, self.level + 1, -(-self.count // FAN_IN)
        return self.runs


class Filter:
    """Bitmaps of the hashes of some values, broadcast to where rows are probed. No value that it holds is missed."""

    def __init__(self, values: DataFrame, column: str, n: int, scratch: Scratch, name: str):
        self.bits = max(_BUCKET_BITS, 1 << max(1, n * FILTER_LOAD - 1).bit_length())
        places = values.select(self._place(F.col(column)).alias("place"))
        bitmaps = places.groupBy(F.floor(F.col("place") / _BUCKET_BITS).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("place") % _BUCKET_BITS).alias("__bits"))
        self.bitmaps = scratch.save(bitmaps, name)

    @staticmethod
    def fits(n: int) -> bool:
        return n * FILTER_LOAD <= FILTER_BYTES * 4  # the next power of two fits, too

    def _place(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.bits))

    def probe(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``__maybe``: whether the filter may hold their value."""
        placed = rows.withColumn("__place", self._place(F.col(column))).withColumn("__bucket", F.floor(F.col("__place") / _BUCKET_BITS))
        bit = (F.col("__place") % _BUCKET_BITS).cast("int")
        byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return placed.join(F.broadcast(self.bitmaps), "__bucket", "left").withColumn("__maybe", F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop("__place", "__bucket", "__bits")


def find_copies(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest=sha256, memtable_rows: int = MEMTABLE_ROWS
) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` for each row of ``docs``.

    Texts are equal if their bytes are after lower-casing A-Z; null counts as empty, and empty texts equal each other.
    Of equal texts the row with the smallest (or ``keep='largest'``) id stays. The id is the key: rows that repeat the
    kept id with the kept text all stay, and null ids stay only where a group has no other. Only id and text are read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("text"))
    entries = scratch.save(texts.select("id", digest(F.col("text")).alias("digest")), "entries")
    index = DigestIndex(scratch)
    total = entries.count()
    index.flush(entries, max(1, -(-total // memtable_rows)))
    run = index.compact()
    best = F.col("low" if keep == "smallest" else "high").alias("keep_id")
    repeated = scratch.save(run.where("n > 1").select("digest", best, "n"), "repeated")
    digests, hit_rows = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # every row's group; what the filter of the repeated digests does not hold needs no join
    alone, rest = None, entries
    if Filter.fits(digests):
        probed = Filter(repeated, "digest", digests, scratch, "digest-filter").probe(entries, "digest")
        alone, rest = probed.where("NOT __maybe").select("id", "digest", F.col("id").alias("keep_id"), F.lit(None).cast("long").alias("n")), probed.where("__maybe").drop("__maybe")
    found = scratch.save(join_hot(rest, repeated, "digest", total, "left").select("id", "digest", "keep_id", "n"), "found")
    groups = found if alone is None else alone.unionByName(found)
    groups = groups.select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "digest")

    # byte verification of the hits: their texts move once, and equal ones of a task together
    ids = found.where("n IS NOT NULL").select("id")
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"))
    if Filter.fits(hit_rows):
        raw = Filter(ids, "id", hit_rows, scratch, "id-filter").probe(raw, "id").where("__maybe")
    else:
        raw = raw.join(ids.distinct().withColumnRenamed("id", "hit"), F.col("id").eqNullSafe(F.col("hit")), "left_semi")
    hits = raw.select(normal(F.col("raw")).alias("text")).select(digest(F.col("text")).alias("digest"), "text")
    kinds = hits.groupBy("digest").agg(F.size(F.collect_set("text")).alias("kinds"))
    differ = scratch.save(kinds.where("kinds > 1").select("digest"), "differ")

    if not differ.isEmpty():  # digests that stand for several texts: group their rows by the texts
        several = texts.withColumn("digest", digest(F.col("text"))).join(differ, "digest", "left_semi")
        exact = several.groupBy("digest", "text").agg((F.min if keep == "smallest" else F.max)("id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = groups.join(differ, "digest", "left_anti").unionByName(several.join(exact, ["digest", "text"]).select("id", "keep_id", "group_size", "digest"))
    return groups.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
