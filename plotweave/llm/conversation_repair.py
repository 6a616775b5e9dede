"""Conversation structure repair (operator 11): the cheapest edits that give a well-formed conversation.

A conversation should have the role initials ``(s?(ua)+)?``. Its rows, in order, and the states of that grammar span a
lattice that is never built: from a node (row, state) edits lead on, each with a cost and a letter. Dijkstra's search
takes nodes by (cost, letters so far) and stops at the first accepting node at the end, so of equally cheap repairs the one
whose letters come first wins.

All conversations are put in order at once, by ranges, so a conversation that holds a third of all rows lies in many tasks.
It is cut into *segments* of at most ``SEGMENT`` rows. One with a single segment is searched from its start. For a longer one
each segment is searched from each of the four states to each, in tasks of their own, and then the segments' tables are
combined in order, a few numbers a segment: two letter sequences that reach one row by different states differ before either
ends, so the order of the sequences so far decides, and only within one segment's table letters are compared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import Scratch, join_hot

#: Rows of a segment, as a power of two.
SEGMENT_BITS = 8
# The costs of the edits and the characters that end a sentence.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STOPS = ".!?"
BLANKS = " \t\n\x0b\f\r"
#: Initials by number; any other role is the number behind them. Faults by number.
INITIALS = "sua"
NO_FAULT, BLANK, DUPLICATE, CUT_OFF = range(4)
#: States: nothing yet, after a system row, after a user's, after an assistant's. Where an initial leads from each of them.
STATES = 4
_NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
#: The initial that a new or rewritten row gets in each state.
_WANTED = tuple(1 if 1 in step else 2 for step in _NEXT)
_ACCEPTING = (0, 3)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def decode(codes: str) -> list[tuple[int, int]]:
    """(initial, fault) of each row."""
    return [divmod(ord(c) - 65, 4) for c in codes]


def search(rows: list[tuple[int, int]], start: int, last: bool, first_only: bool) -> list[tuple[int, str] | None]:
    """(cost, letters) of the best way from ``start`` to each state behind the rows; None where there is none.

    Behind the ``last`` rows only accepting states count, and rows may be inserted there, too. With ``first_only`` the search
    stops at the first of them.
    """
    heap, done, out = [(0, "", 0, start)], set(), [None] * STATES
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        wanted = _NEXT[state][_WANTED[state]]
        if at == len(rows):
            if not last:
                out[state] = cost, audit
                continue
            if state in _ACCEPTING:
                out[state] = cost, audit
                if first_only:
                    return out
        else:
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if fault in (NO_FAULT, CUT_OFF):
                more = cost + (TRUNCATED if fault == CUT_OFF else 0)
                if initial in _NEXT[state]:
                    heapq.heappush(heap, (more + KEEP, audit + "K", at + 1, _NEXT[state][initial]))
                heapq.heappush(heap, (more + REROLE, audit + "R", at + 1, wanted))
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, wanted))
    return out


def repair_one(rows: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, letters) for a conversation of one segment."""
    return min(x for x in search(rows, 0, True, True) if x is not None)


def spell(rows: list[tuple[int, int]], start: int, audit: str) -> str:
    """The letters with the role that each sets: I becomes u or a, R becomes U or A."""
    state, at, out = start, 0, []
    for letter in audit:
        if letter in "IR":
            wanted = _WANTED[state]
            state = _NEXT[state][wanted]
            out.append(INITIALS[wanted] if letter == "I" else INITIALS[wanted].upper())
        else:
            state = _NEXT[state][rows[at][0]] if letter == "K" else state
            out.append(letter)
        at += letter != "I"
    return "".join(out)


def illegal_pairs(rows: list[tuple[int, int]]) -> int:
    return sum((a[0], b[0]) not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))


def combine(tables: Iterator[tuple[list[int], list[int]]]) -> list[int]:
    """For each segment in order, the place (from state * STATES + to state) of its table that the best repair takes.

    A table has the costs of all ways (-1: none) and the order of their letters among those from the same state.
    """
    now: dict[int, tuple[int, int]] = {0: (0, 0)}  # state: cost, and order of the letters so far
    back: list[dict[int, int]] = []
    for costs, order in tables:
        best: dict[int, tuple[int, int, int, int]] = {}
        for state, (cost, rank) in now.items():
            for to in range(STATES):
                if (more := costs[state * STATES + to]) >= 0:
                    found = cost + more, rank, order[state * STATES + to], state
                    if to not in best or found < best[to]:
                        best[to] = found
        ranks = {to: n for n, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        back.append({to: x[3] for to, x in best.items()})
        now = {to: (x[0], ranks[to]) for to, x in best.items()}
    state, out = min(now, key=now.__getitem__), []
    for step in reversed(back):
        out.append(step[state] * STATES + state)
        state = step[state]
    return out[::-1]


def _single_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(decode(codes)) for codes in batch.column(2).to_pylist()]
        best = [repair_one(rows) for rows in found]
        columns = [pa.array([c for c, _ in best], pa.int64()), pa.array([illegal_pairs(rows) for rows in found], pa.int64()), pa.array([spell(rows, 0, a) for rows, (_, a) in zip(found, best, strict=True)], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "segment", "cost", "illegal", "edits"])


def _table_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, segment, codes, last): the segment's table, pairs and edges."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for codes, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            rows = decode(codes)
            ways = [search(rows, start, last, False) for start in range(STATES)]
            order = [sorted(x[1] for x in row if x) for row in ways]
            out[0].append([x[0] if x else -1 for row in ways for x in row])
            out[1].append([o.index(x[1]) if x else -1 for row, o in zip(ways, order, strict=True) for x in row])
            out[2].append([spell(rows, start, x[1]) if x else None for start, row in enumerate(ways) for x in row])
            for place, value in enumerate((illegal_pairs(rows), rows[0][0], rows[-1][0]), 3):
                out[place].append(value)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["key", "segment", "costs", "orders", "edits", "illegal", "head", "tail"])


def _combine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, segment, costs, orders, head, tail) in order: what to take of each table, and the pair across its start."""

    def close(key, held):
        picks = combine((costs, order) for _, costs, order, _, _ in held)
        cross = [0, *(int((a[4], b[3]) not in _LEGAL) for a, b in zip(held, held[1:], strict=False))]
        return pa.RecordBatch.from_arrays([pa.array([key] * len(held), pa.string()), pa.array([x[0] for x in held], pa.int64()), pa.array(picks, pa.int32()), pa.array(cross, pa.int64())], names=["key", "segment", "pick", "cross"])

    at, held = None, []
    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if held:
                    yield close(at, held)
                at, held = key, []
            held.append(rest)
    if held:
        yield close(at, held)


def conversation_key(conv: Column) -> Column:
    """The id as text; null is one space."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def _fault(text: Column) -> Column:
    """Blank and truncated texts by number."""
    end = F.rtrim(text, F.lit(BLANKS))
    return F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(*STOPS), NO_FAULT).otherwise(CUT_OFF)


def _initial(role: Column) -> Column:
    at = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    return F.when((F.length(role) > 0) & (at > 0), at - 1).otherwise(len(INITIALS))


class Repair:
    """The repair of all conversations of ``turns``: ``summary`` and the repaired ``rows``.

    Rows are taken by turn (nulls first), then role and text; nulls in role or text count as one space, and so does a null id.
    A row's first fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the
    conversation), truncated (its last character that is no white space is not one of ``.!?``). Edits are Keep, Rerole (to user or assistant),
    Delete (a must for blank and duplicate rows) and Insert (an empty row of user or assistant); truncated rows that stay
    cost more. Very long texts are read where they lie and never gathered; a conversation of many rows is dealt to many tasks.
    An empty table has no conversations. Only the four columns are read, so the names of others cannot clash.
    """

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self.conv_col, self.conv_type = conv_col, turns.schema[conv_col].dataType
        scratch = Scratch(turns.sparkSession, "conversations")
        rows = turns.select(conversation_key(F.col(conv_col)).alias("key"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
        order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
        self.ordered = scratch.save(rows.withColumn("segment", F.shiftright("pos", SEGMENT_BITS)), "ordered")

        # rows whose role and text were seen before
        sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
        mark = F.unhex(F.sha2(F.concat(sized("key"), sized("role"), F.col("text")), 256))
        narrow = self.ordered.select("key", "pos", "segment", "turn", _initial(F.col("role")).alias("initial"), _fault(F.col("text")).alias("fault"), mark.alias("mark"))
        repeated = scratch.save(narrow.groupBy("mark").agg(F.min("pos").alias("low"), F.count("*").alias("n")).where("n > 1"), "repeated")
        found = join_hot(narrow, repeated, "mark", self.ordered.count(), "left")
        fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("low")), DUPLICATE).otherwise(F.col("fault"))
        found = scratch.save(found.select("key", "pos", "segment", "turn", "initial", fault.alias("fault")), "faults")
        scratch.drop("repeated")

        code = F.char(65 + 4 * F.col("initial") + F.col("fault"))
        codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x["code"]), "")
        segments = scratch.save(found.groupBy("key", "segment").agg(codes.alias("codes"), F.min("pos").alias("at")), "segments")
        ends = segments.groupBy("key").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
        sized = segments.join(ends, "key")
        pieces = sized.where("low = high").select("key", "segment", "codes").mapInArrow(_single_batches, "key string, segment long, cost long, illegal long, edits string")
        long = sized.where("low < high").select("key", "segment", "codes", (F.col("segment") == F.col("high")).alias("last"))
        table = "key string, segment long, costs array<long>, orders array<int>, edits array<string>, illegal long, head int, tail int"
        tables = scratch.save(long.mapInArrow(_table_batches, table), "tables")
        if not tables.isEmpty():
            ways = tables.select("key", "segment", "costs", "orders", "head", "tail").repartition("key").sortWithinPartitions("key", "segment")
            picks = ways.mapInArrow(_combine_batches, "key string, segment long, pick int, cross long")
            at = F.col("pick") + 1
            pieces = pieces.unionByName(tables.join(picks, ["key", "segment"]).select("key", "segment", F.element_at("costs", at).alias("cost"), (F.col("illegal") + F.col("cross")).alias("illegal"), F.element_at("edits", at).alias("edits")))
        self.pieces = scratch.save(pieces.join(segments.select("key", "segment", "at"), ["key", "segment"]), "pieces")

        count = lambda n: F.count_if(F.col("fault") == n)
        stats = found.groupBy("key").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT_OFF).alias("truncated"),
        )
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "edits"))), lambda x: x["edits"]), "")
        audit = F.translate(audit, "uaUA", "IIRR")
        edits = self.pieces.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
        self._summary = stats.join(edits, "key")

    def _named(self, df: DataFrame) -> DataFrame:
        """The id instead of its text; an id that is one space as text cannot be told from a null."""
        conv = F.when(F.col("key") != " ", F.col("key")).cast(self.conv_type)
        return df.select(conv.alias(self.conv_col), *(c for c in df.columns if c != "key"))

    def summary(self) -> DataFrame:
        """``id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for each conversation that has rows."""
        return self._named(self._summary)

    def _rows(self) -> DataFrame:
        steps = F.regexp_extract_all("edits", F.lit("[ua]*[DKUA]|[ua]+$"), 0)
        both = self.ordered.join(self.pieces.select("key", "segment", "at", steps.alias("steps")), ["key", "segment"])
        here = (F.col("pos") - F.col("at") + 1).cast("int")
        # what is inserted behind the last row is a step of no row; that row takes it, too
        behind = F.when((here == F.size("steps") - 1) & F.element_at("steps", -1).rlike("[ua]$"), F.element_at("steps", -1)).otherwise("")
        letters = F.split(F.concat(F.element_at("steps", here), behind), "")
        each = both.select("key", "pos", "role", "text", F.posexplode(letters).alias("nth", "edit")).where("edit <> 'D'")
        role = F.when(F.col("edit").isin("u", "U"), "user").when(F.col("edit").isin("a", "A"), "assistant").otherwise(F.col("role"))
        text = F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text"))
        return each.select("key", "pos", "nth", F.translate("edit", "uaUA", "IIRR").alias("edit"), role.alias("role"), text.alias("text"))

    def rows(self) -> DataFrame:
        """``id, pos, nth, edit, role, text``: the rows that stay or are new, in the order of pos and nth."""
        return self._named(self._rows())

    def digests(self) -> DataFrame:
        """``id, repaired_sha256``: the digest of the repaired ``role:text``, joined by newlines, for conversations with rows left.

        It is one number over all of a conversation, so its rows pass through one task, in order; none is held there.
        """
        rows = self._rows().select("key", "pos", "nth", "role", "text").repartition("key").sortWithinPartitions("key", "pos", "nth")
        return self._named(rows.select("key", "role", "text").mapInArrow(_digest_batches, "key string, repaired_sha256 string"))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["key", "repaired_sha256"])

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for i, (key, role) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != at:
                if digest is not None:
                    yield told()
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(role.encode() + b":")
            digest.update(texts[i].as_buffer())
    if digest is not None:
        yield told()


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` (these four columns) with faults, by the crc32 of ``id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes
    ``.!?`` out of it, 3 repeats the row, 4 sets the role user. Nulls (but the turn's and the id's own) become one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")), F.lit(20))
    kinds = turns.select(conv_col, turn_col, text(role_col).alias(role_col), text(text_col).alias(text_col), kind.alias("__kind")).where("__kind <> 0")
    said = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col(role_col))
    copies = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")
    return kinds.select(conv_col, turn_col, role.alias(role_col), said.alias(text_col), copies).drop("__copy")


def repair_damaged(turns: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """``id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of all conversations of ``turns`` once ``damage`` is done.

    A conversation that has lost all rows has zeros, no letters, and the digest of nothing, as has one whose rows all go.
    """
    repair = Repair(damage(turns, conv_col, **columns), conv_col, **columns)
    key = conversation_key(F.col(conv_col)).alias("__key")
    every = turns.groupBy(key).agg(F.first(conv_col).alias(conv_col))
    left = repair.summary().withColumn("__key", key).drop(conv_col).join(repair.digests().withColumn("__key", key).drop(conv_col), "__key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(left, "__key", "left").select(conv_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
