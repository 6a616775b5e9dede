"""Substring dedup (operator 12): recompression of word sequences, one naming for all documents.

Words are symbols. A round of recompression gives each maximal run of one symbol a name, then puts every symbol on one of
two sides and names each pair that stands left-right; ``ROUNDS`` of them are made. A name is a 64-bit fingerprint of what it
stands for, so every task gives the same names without a dictionary, and equal stretches have equal symbols inside. How
far a symbol depends on its surroundings is followed through the rounds: its *context* is the stretch of words that
decides it. Every window of ``width`` words picks, of the symbols whose context lies inside it, one of the highest round,
there the smallest (by a hash); equal windows pick equal symbols wherever they stand. A window without such a symbol (within a
long run) stands for itself. Consecutive windows with one pick form a *unit*.

Spark rounds then settle which units repeat, each over what the one before could not settle:

1. The names of all units' contexts are counted. A window whose context occurs once is unique: most text ends here.
2. Units with the same words are grouped; all windows of a unit that is not the first of its group repeat. This settles
   long repeats, a few rows for each, whether a passage has two copies or thousands.
3. Windows of the first units are compared one by one, by 128 bits of all of their words.

Counts and minima combine before each shuffle, so a passage that a third of all documents hold is no hot key. Nothing
but row counts and a filter of checked size comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm import ragged
from plotweave.llm.common import Scratch, join_hot
from plotweave.llm.exact_dedup import Filter

#: Rounds of recompression: with one more, few windows of 20 words hold the context of a symbol.
ROUNDS = 3
#: Words of one text that are parsed together. Windows near a cut see both sides of it, and symbols depend on their contexts only.
PIECE = 1 << 19

_STEP, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_powers: dict[int, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _STEP
        h = (h ^ (h >> np.uint64(29))) * _FOLD
        return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    """At least n powers of ``base`` modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(steps)
    return _powers[base]


class Slices:
    """Fingerprints of slices of a sequence: polynomials modulo 2^64 by prefix sums, mixed with the slice's length."""

    def __init__(self, marks: np.ndarray, which: int):
        self.inverse = pow(_BASES[which], -1, 1 << 64)
        self.sums = np.zeros(len(marks) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(marks * _power(_BASES[which], len(marks))[: len(marks)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * _power(self.inverse, len(self.sums))[starts]
            return _mix(h + (ends - starts).astype(np.uint64) * _STEP)


class Symbols:
    """The symbols of rows of words: name, row, and the context [low, high) in words; one outside its row's words is open."""

    def __init__(self, names: np.ndarray, first: np.ndarray):
        n = len(names)
        self.names, self.low, self.high = names, np.arange(n), np.arange(1, n + 1)
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.before, self.after = first[:-1] - 1, first[1:] + 1

    def _edges(self) -> np.ndarray:
        """Whether a symbol begins its row; one more for the end."""
        edge = np.ones(len(self.row) + 1, bool)
        edge[1:-1] = self.row[1:] != self.row[:-1]
        return edge

    def _left(self) -> np.ndarray:
        """Where the context of the symbol before begins, or open."""
        return np.where(self._edges()[:-1], self.before[self.row], np.concatenate([[0], self.low[:-1]]))

    def _right(self) -> np.ndarray:
        return np.where(self._edges()[1:], self.after[self.row], np.concatenate([self.high[1:], [0]]))

    def _take(self, first: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.names, self.row, self.low, self.high = names, self.row[first], low, high

    def runs(self, salt: int) -> None:
        """Maximal runs as one symbol each. That a run ends is known from the symbols on either side."""
        if not len(self.names):
            return
        new = self._edges()
        new[1:-1] |= self.names[1:] != self.names[:-1]
        at = np.flatnonzero(new)
        first, last = at[:-1], at[1:] - 1
        length = last - first + 1
        with np.errstate(over="ignore"):
            many = _mix(self.names[first] * _STEP + length.astype(np.uint64) * _FOLD + np.uint64(salt))
        self._take(first, np.where(length > 1, many, self.names[first]), self._left()[first], self._right()[last])

    def pairs(self, salt: int) -> None:
        """Each left symbol with a right one behind it as one symbol. Others depend on the symbol that could have joined."""
        if not len(self.names):
            return
        left = (_mix(self.names + np.uint64(salt)) >> np.uint64(63)).astype(bool)
        joined = np.zeros(len(left) + 1, bool)
        joined[1:-1] = left[:-1] & ~left[1:] & ~self._edges()[1:-1]  # joined[i]: symbol i goes into the one before
        first = np.flatnonzero(~joined[:-1])
        pair = joined[first + 1]
        low = np.where(~left[first], self._left()[first], self.low[first])
        high = np.where(pair, self.high[np.minimum(first + 1, len(left) - 1)], np.where(left[first], self._right()[first], self.high[first]))
        with np.errstate(over="ignore"):
            both = _mix(self.names[first] * _STEP + _mix(self.names[np.minimum(first + 1, len(left) - 1)] * _FOLD + np.uint64(salt)))
        self._take(first, np.where(pair, both, self.names[first]), low, high)


def recompress(names: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, low, high) of the symbols after each round; ``first`` has the rows' first words and the end."""
    symbols, out = Symbols(names, first), []
    for n in range(rounds):
        symbols.runs(4 * n + 1)
        symbols.pairs(4 * n + 2)
        out.append((symbols.names, symbols.low, symbols.high))
    return out


def _smallest(ranks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the smallest (the first of several) of ``ranks[a:b]`` for each of these ranges, none of them empty."""
    best, todo, step = a.copy(), np.flatnonzero(b - a > 1), 1
    while len(todo):
        at = a[todo] + step
        less = ranks[at] < ranks[best[todo]]
        best[todo[less]] = at[less]
        todo = todo[at + 1 < b[todo]]
        step += 1
    return best


def units(names: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """``row, start, count, key, content`` of all units: ``count`` windows from word ``start`` of the row on, the fingerprint
    of their common context, and that of all their words."""
    size = np.maximum(np.diff(first) - width + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[:-1][row]
    low, high, pick = at.copy(), at + width, -1 - at  # a window stands for itself unless it holds a symbol's context
    left = np.arange(len(at))
    for level, (symbol, begins, ends) in reversed(list(enumerate(recompress(names, first, rounds)))):
        a, b = np.searchsorted(begins, at[left], "left"), np.searchsorted(ends, at[left] + width, "right")
        has = a < b
        found = _smallest(_mix(symbol ^ _STEP), a[has], b[has])
        some = left[has]
        low[some], high[some], pick[some] = begins[found], ends[found], found * (rounds + 1) + level
        left = left[~has]
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    key = Slices(names, 0).of(low[begin], high[begin])
    content = Slices(names, 1).of(start, start + count + width - 1)
    return row[begin], start - first[:-1][row[begin]], count, key, content


def _word_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and the rows' first words."""
    starts, ends = ragged.runs(~ragged.SPACE[data], offsets)
    return ragged.hashes(data, starts, ends), np.concatenate([[0], np.cumsum(ragged.per_row(starts, offsets))])


def _unit_batches(batches: Iterator[pa.RecordBatch], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Units of rows (id, tie, text)."""
    for batch in batches:
        data, offsets = ragged.utf8(batch.column(2))
        for a, b in ragged.blocks(offsets):
            marks, first = _word_marks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            long = b - a == 1 and len(marks) > PIECE
            for skip in range(0, len(marks) - width + 1 if long else 1, PIECE):
                part = marks[skip : skip + PIECE + width - 1] if long else marks
                row, start, count, key, content = units(part, np.array([0, len(part)]) if long else first, width)
                if len(row):
                    at = pa.array(row + a)
                    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array((start + skip).astype(np.int32)), pa.array(count.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, starts and counts of a column of lists of (start, count); a null is an empty list."""
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    inner = column.flatten()
    return offsets, inner.field(0).to_numpy(zero_copy_only=False).astype(np.int64), inner.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _window_batches(batches: Iterator[pa.RecordBatch], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the windows of some units; rows (id, tie, text, units)."""
    for batch in batches:
        data, offsets = ragged.utf8(batch.column(2))
        where, starts, counts = _flat(batch.column(3))
        for a, b in ragged.blocks(offsets):
            marks, first = _word_marks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            some = slice(where[a], where[b])
            n, owner = counts[some], np.repeat(np.arange(b - a), np.diff(where[a : b + 1]))
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, row = np.repeat(starts[some], n) + inside, np.repeat(owner, n)
            at = start + first[:-1][row]
            ones = [Slices(marks, i).of(at, at + width) for i in (0, 1)]
            who = pa.array(row + a)
            columns = [*(pa.array(h.view(np.int64)) for h in ones), batch.column(0).take(who), batch.column(1).take(who), pa.array(start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _kept_batches(batches: Iterator[pa.RecordBatch], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What is left of rows (id, tie, text, units that may repeat, first windows among them)."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        (c, c_start, c_count), (f, f_start, _) = _flat(batch.column(3)), _flat(batch.column(4))
        n_words, n_removed, kept, spans = [], [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or b"").split()
            cut: list[dict] = []
            if c[i + 1] > c[i]:
                windows = np.zeros(len(words) + 1, np.int64)
                some = slice(c[i], c[i + 1])
                np.add.at(windows, c_start[some], 1)
                np.add.at(windows, c_start[some] + c_count[some], -1)
                repeats = np.cumsum(windows)[:-1] > 0
                repeats[f_start[f[i] : f[i + 1]]] = False
                at = np.flatnonzero(repeats)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
                first, last = ragged.runs(np.cumsum(cover)[:-1] > 0, np.array([0, len(words)]))
                cut = [{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            edges = [0, *(x for s in cut for x in s.values()), len(words)]
            stay = words if not cut else [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay))
            spans.append(cut)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _same_row(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["tie"] == b["tie"])


def _of_rows(listed: DataFrame, name: str) -> DataFrame:
    """The distinct (start, count) of each row, as one list: no longer than the row's own text."""
    return listed.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "count")).alias(name))


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept_text, removed array<struct<start, end>>`` for each row of ``docs``.

    Words stand between ASCII white space. A word goes if a window of ``width`` consecutive words of its text covers it whose
    words also start earlier: in a smaller id, or earlier in the same text. All windows are judged on the input. ``kept_text``
    joins the other words with single spaces, ``removed`` has the ranges of words that went. Null and empty texts have no
    words; a text of fewer than ``width`` words stays whole. A null id comes before all others; of different texts with one id
    the order is that of their hashes; of rows with one id and one text the first (any) keeps what the others lose. Every
    row gives one row; other columns are not read, so their names cannot clash. Long texts are parsed in pieces that change nothing.

    Equal words have equal 62-bit hashes; windows are compared by 128 bits over these. The texts are shuffled twice, and of
    the units all names and those that may repeat.
    """
    if width < 1:
        raise ValueError("width is at least 1")
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType
    row = [T.StructField("id", id_type), T.StructField("tie", T.LongType())]

    def table(*fields: T.StructField) -> tuple[T.StructType, list[str]]:
        schema = T.StructType(list(fields))
        return schema, schema.fieldNames()

    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    number = lambda *names: [T.StructField(n, T.IntegerType()) for n in names]

    # 1. units whose context occurs more than once
    schema, names = table(*row, *long("key", "content"), *number("start", "count"))
    every = scratch.save(source.mapInArrow(lambda b, n=names: _unit_batches(b, width, n), schema), "units")
    shared = scratch.save(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    keys = shared.count()
    if Filter.fits(keys):  # what it holds too much is told apart by the next rounds
        found = Filter(shared, "key", keys, scratch, "filter").probe(every, "key").where("__maybe").drop("__maybe")
    else:
        found = join_hot(every, shared, "key", every.count()).drop("n")
    found = scratch.save(found, "found")
    scratch.drop("units", "shared", "filter")

    # 2. the first unit of each content
    firsts = found.groupBy("key", "content").agg(F.min(F.struct("id", "tie", "start")).alias("f"), F.max("count").alias("count"))
    firsts = scratch.save(firsts.select("f.*", "count"), "first-units")

    # 3. the first of equal windows in these
    listed = _of_rows(firsts, "units")
    schema, names = table(*long("one", "two"), *row, *number("start"))
    asked = source.join(listed, _same_row(source, listed)).select(source["id"], source["tie"], "text", "units")
    windows = asked.mapInArrow(lambda b, n=names: _window_batches(b, width, n), schema)
    stay = windows.groupBy("one", "two").agg(F.min(F.struct("id", "tie", "start")).alias("f")).select("f.*")
    stay = scratch.save(stay, "first-windows")
    scratch.drop("first-units")

    # what goes: windows of the units found, but for the first ones
    marked = found.select("id", "tie", "start", "count", F.lit(False).alias("first")).unionByName(stay.select("id", "tie", "start", F.lit(1).alias("count"), F.lit(True).alias("first")))
    spot = F.struct("start", "count")
    marked = marked.groupBy("id", "tie").agg(F.collect_set(F.when(~F.col("first"), spot)).alias("units"), F.collect_set(F.when(F.col("first"), spot)).alias("stay"))
    schema, names = table(*row, *long("n_words", "n_removed"), T.StructField("kept_text", T.StringType()), T.StructField("removed", T._parse_datatype_string("array<struct<start int, end int>>")))
    joined = source.join(marked, _same_row(source, marked), "left").select(source["id"], source["tie"], "text", "units", "stay")
    out = joined.mapInArrow(lambda b, n=names: _kept_batches(b, width, n), schema)

    # rows that repeat an id with its text: one of them is the first
    again = scratch.save(source.groupBy("id", "tie").agg(F.count("*").alias("n")).where("n > 1"), "again")
    if not again.isEmpty():
        one = out.join(again, _same_row(out, again), "left_anti")
        several = out.join(again, _same_row(out, again)).select(*(out[c] for c in names), "n").dropDuplicates(["id", "tie"])
        several = several.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("gone", (F.col("nth") > 1) & (F.col("n_words") >= width))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
        several = several.withColumns({"n_removed": F.when(F.col("gone"), F.col("n_words")).otherwise(F.col("n_removed")), "kept_text": F.when(F.col("gone"), "").otherwise(F.col("kept_text")), "removed": F.when(F.col("gone"), whole).otherwise(F.col("removed"))})
        out = one.unionByName(several.select(*names))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", "removed")
