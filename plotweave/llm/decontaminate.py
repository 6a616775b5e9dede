"""Benchmark decontamination (operator 2): one Aho-Corasick automaton, one scan of each text.

Texts and items are normalised byte by byte (A-Z lower-cased, everything that is not a digit, a-z or a byte of a
non-ASCII character a space), so a byte of the normalised text has the same place in the original. Words of the items
have numbers, written as a few symbols each, and all other words are number 0.

An item of ``width`` words or more is cut into blocks of half that many words, from its first word on; each of its windows
of ``width`` words holds a whole block. The automaton holds all blocks, which is no more text than the items have (all
windows would be ``width`` times as much), and whole items where they are shorter. Where a block occurs, the words beside
it are compared with those beside it in the item; every stretch of ``width`` equal words or more is hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plotweave.llm import ragged

#: Bytes of item text that are broadcast and put into the automaton, at most: about 20 bytes of memory for each of them.
ITEM_BYTES = 1 << 24

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

_built: dict[tuple[str, int], "Items"] = {}


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """The automaton over the items' blocks, and what stands beside each block."""

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        import ahocorasick

        cut = [(item, normal_words(text)) for item, text in items]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in cut for w in words), 1)}
        self.digits = max(1, -(-len(self.numbers).bit_length() // 6))
        if self.digits > 4:
            raise ValueError("more distinct words in the items than four symbols can number")
        half = (width + 1) // 2
        places: dict[bytes, dict[tuple, set]] = {}
        for item, words in cut:
            ids = np.array([self.numbers[w] for w in words], np.int64)
            n = len(ids)
            for at in range(0, n - half + 1, half) if n >= width else [0] * (n > 0):
                to = at + half if n >= width else n
                beside = (tuple(ids[max(0, to - width) : at].tolist()), tuple(ids[to : at + width].tolist())) if n >= width else ((), ())
                owners = places.setdefault(self.symbols(ids[at:to]), {}).setdefault((to - at, min(n, width), *beside), set())
                if item is not None:
                    owners.add(item)
        self.automaton = ahocorasick.Automaton() if places else None
        for block, found in places.items():
            self.automaton.add_word(block, [(*place, tuple(owners)) for place, owners in found.items()])
        if places:
            self.automaton.make_automaton()

    def symbols(self, ids: np.ndarray) -> str:
        """``digits`` characters for each number; each place has its own 64 of them, so no match begins inside a word."""
        out = np.empty((len(ids), self.digits), np.uint8)
        for k in range(self.digits):
            out[:, k] = ((ids >> (6 * (self.digits - 1 - k))) & 63) + 64 * k
        return out.tobytes().decode("latin-1")

    def scan(self, text: bytes | None) -> tuple[int, set, np.ndarray | None]:
        """Number of words, the items with an occurring window, and the mask of hit words (None: no hit)."""
        words = normal_words(text) if text else []
        if not words or self.automaton is None:
            return len(words), set(), None
        number = self.numbers.get
        ids = [number(w, 0) for w in words]
        found, edge = set(), None
        for end, places in self.automaton.iter(self.symbols(np.array(ids, np.int64))):
            to = (end + 1) // self.digits
            for size, least, before, after, owners in places:
                a, b = to - size, to
                for x in reversed(before):
                    if not a or ids[a - 1] != x:
                        break
                    a -= 1
                for x in after:
                    if b == len(ids) or ids[b] != x:
                        break
                    b += 1
                if b - a >= least:
                    edge = np.zeros(len(ids) + 1, np.int64) if edge is None else edge
                    edge[a] += 1
                    edge[b] -= 1
                    found.update(owners)
        return len(words), found, None if edge is None else np.cumsum(edge)[:-1] > 0


def hold_items(items: DataFrame, id_col: str, text_col: str) -> tuple[str, object]:
    """The items (null texts left out) as a named broadcast, once their size has been checked."""
    kept = items.select(id_col, text_col).where(F.col(text_col).isNotNull())
    size = kept.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    if size > ITEM_BYTES:
        raise ValueError(f"{size} bytes of item text; one automaton takes {ITEM_BYTES}: deal the items to several calls")
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(item, text.encode()) for item, text in kept.collect()])


def _items(held: tuple[str, object], width: int) -> Items:
    """A worker builds the automaton once and keeps it from one batch and task to the next."""
    if (held[0], width) not in _built:
        _built.clear()
        _built[held[0], width] = Items(held[1].value, width)
    return _built[held[0], width]


def hit_spans(text: bytes, mask: np.ndarray) -> list[dict]:
    """Maximal runs of hit words, as offsets (code points) into the original text."""
    raw = np.frombuffer(text.translate(_FOLD), np.uint8)
    starts, ends = ragged.runs(raw != 0x20, np.array([0, len(raw)]))
    first, last = ragged.runs(mask, np.array([0, len(mask)]))
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(lead[starts[a]]), "end": int(lead[ends[b - 1]])} for a, b in zip(first, last, strict=True)]


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, n_words, n_hit, item_ids, spans array<struct<start, end>>`` for each row of ``docs``.

    A word inside any occurrence of an item's window is hit; ``item_ids`` (ascending) are the items with an occurring
    window. Null and empty texts have no words; without items nothing is hit; items that repeat a text are all named,
    those without an id count as hits only.
    Every row gives one row, and no other column is read. There is no shuffle and no limit on text length or hits; items
    with more than ``ITEM_BYTES`` of text are refused.
    """
    held = hold_items(items, item_col, item_text)
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    item_type = items.schema[item_col].dataType.simpleString()
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(held, width)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [known.scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([0 if m is None else int(m.sum()) for _, _, m in found], pa.int64()),
                    pa.array([sorted(s) for _, s, _ in found], pa.list_(item_arrow)),
                    pa.array([[] if m is None else hit_spans(t, m) for t, (_, _, m) in zip(texts, found, strict=True)], span),
                ],
                names=[id_col, "n_words", "n_hit", "item_ids", "spans"],
            )

    return source.mapInArrow(find, f"`{id_col}` {id_type}, n_words long, n_hit long, item_ids array<{item_type}>, spans array<struct<start: long, end: long>>")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no item's window occurs."""
    held = hold_items(items, item_col, item_text)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(held, width)
        for batch in batches:
            yield batch.filter(pa.array([known.scan(t)[2] is None for t in batch.column(place).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
