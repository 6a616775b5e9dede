"""Byte-level BPE over batches of pre-tokens, by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie behind each other in one flat symbol array. In every round each pre-token
applies its own lowest-ranked pair, at all its places at once (overlapping places of a pair ``aa`` from the left),
so the number of rounds is that of the pre-token with most merges, and the work of a round is a few array operations.
In a vocabulary where every merge uses symbols made by earlier merges this gives what one merge at a time gives.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np

from plotweave.llm import ragged

#: Distinct pre-tokens that a worker remembers, over all its tasks; further ones are encoded each time.
REMEMBER = 600_000
#: Longer ones (in code points) are not remembered.
LONG = 64
#: Pre-tokens of so many bytes or fewer fit, with their length, into two words of 64 bits.
SHORT = 15

#: Size of the table of pairs, as a power of two.
SLOT_BITS = 19

_NONE = np.int64(1) << 60

# The code points of Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the byte-level pre-tokenizer.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3


@dataclass
class Vocabulary:
    """What the encoder needs of a byte-level BPE file."""

    byte_ids: np.ndarray  # id of each single byte
    keys: np.ndarray  # open-addressed table of pairs, as left * size + right; -1 is free
    ranks: np.ndarray  # of the pairs in that table
    merged: np.ndarray  # id of the symbol each rank makes
    size: int
    specials: dict[str, int]
    name: str
    widths: np.ndarray  # bytes of text that each id stands for

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``."""
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], _NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << SLOT_BITS) - 1)
            found = self.keys[at]
            hit = found == key[left]
            out[left[hit]] = self.ranks[at[hit]]
            going = ~hit & (found >= 0)
            left, at = left[going], at[going]
        return out


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load(path: str) -> Vocabulary:
    """Read a ``tokenizer.json`` whose pre-tokenizer is byte-level without a prefix space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
        raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space can be encoded here")
    vocab = spec["model"]["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    if len(keys) > 1 << (SLOT_BITS - 1):
        raise ValueError(f"{path}: more merges than the table of pairs holds")
    widths = np.zeros(size, np.int64)
    for token, number in vocab.items():
        widths[number] = len(token)
    for t in spec["added_tokens"]:
        widths[t["id"]] = len(t["content"].encode())
    out = Vocabulary(
        byte_ids=np.array([vocab[c] for c in byte_alphabet()], np.int32),
        keys=np.full(1 << SLOT_BITS, -1, np.int64),
        ranks=np.zeros(1 << SLOT_BITS, np.int64),
        merged=np.array([vocab[a + b] for a, b in merges], np.int32),
        size=size,
        specials={t["content"]: t["id"] for t in spec["added_tokens"]},
        name=hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest(),
        widths=widths,
    )
    for rank, (key, at) in enumerate(zip(keys.tolist(), out.slot(keys).tolist(), strict=True)):
        while out.keys[at] >= 0:
            at = (at + 1) & ((1 << SLOT_BITS) - 1)
        out.keys[at], out.ranks[at] = key, rank
    return out


_classes: np.ndarray | None = None


def char_classes(points: np.ndarray) -> np.ndarray:
    """Letter, number, white space or other, of each code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        _classes[WHITE_SPACE] = BLANK
    return _classes[points]


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of rows of code points.

    A pre-token is a contraction, or a run of letters, of numbers or of other characters, each with one space before it
    if there is one, or a run of white space; the last character of a run of white space stands apart if text follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes(points)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[row_start[:n]] = 255
    blank = kind == BLANK
    ends_here = np.empty(n, bool)  # the row's last character
    ends_here[:] = row_start[1:]
    next_blank = np.empty(n, bool)
    next_blank[-1], next_blank[:-1] = False, blank[1:]
    cut = before != kind
    # a space directly before text belongs to it
    led = np.empty(n, bool)  # has such a space before it
    led[0], led[1:] = False, points[:-1] == 0x20
    led &= ~blank & ~row_start[:n]
    cut[led] = False
    # the last character of a run of white space that text follows begins a pre-token: its own, or that of the text
    cut |= blank & ~next_blank & ~ends_here
    # contractions, where no run of other characters or space takes the apostrophe
    marks = np.flatnonzero((points == 0x27) & cut)
    if len(marks):
        tail = np.concatenate([points, np.zeros(2, points.dtype)])
        row_end = offsets[np.searchsorted(offsets, marks, "right")]
        for text in CONTRACTIONS:
            fits = marks + 1 + len(text) <= row_end
            for j, c in enumerate(text):
                fits &= tail[np.minimum(marks + 1 + j, n + 1)] == ord(c)
            done = marks[fits]
            cut[done + 1] = False
            after = done + 1 + len(text)
            cut[after[after < n]] = True
            # a space after it keeps its own place: the rule above has already cut there
            marks, row_end = marks[~fits], row_end[~fits]
    return np.flatnonzero(cut)


_KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def packed(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each slice and its length as two words: equal words, equal slices. Only for slices up to ``SHORT``."""
    held = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray((len(data) + 9,), "<u8", held, strides=(1,))
    low = at[starts] & _KEPT[np.minimum(size, 8)]
    high = at[starts + 8] & _KEPT[np.clip(size - 8, 0, 7)]
    return low, high | size.astype(np.uint64) << np.uint64(56)


class Places:
    """Open-addressed table from packed pre-tokens to their places, for whole arrays at once; at most half full."""

    def __init__(self):
        self.n = 0
        self._clear(12)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high, self.place = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each, or -1."""
        at = self._slot(low, high)
        place = self.place[at]
        out = np.where((self.low[at] == low) & (self.high[at] == high), place, -1).astype(np.int64)
        left = np.flatnonzero((out < 0) & (place >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            place = self.place[at]
            hit = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (place >= 0)
            out[left[hit]] = place[hit]
            going = ~hit & (place >= 0)
            left, at = left[going], at[going]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        """Pre-tokens that differ from each other and from those in the table, with places that no other has."""
        self.n += len(low)
        if 2 * self.n > 1 << self.bits:
            full = np.flatnonzero(self.place >= 0)
            held = self.low[full], self.high[full], self.place[full]
            self._clear((2 * self.n - 1).bit_length())
            self._put(*held)
        self._put(low, high, places)

    def _put(self, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        left, at = np.arange(len(low)), self._slot(low, high)
        while len(left):
            free = self.place[at] < 0
            self.place[at[free]] = places[left[free]]
            won = self.place[at] == places[left]  # of several for one slot, the last
            self.low[at[won]], self.high[at[won]] = low[left[won]], high[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: Vocabulary, keep_ids: bool) -> Encoder:
    """A worker's encoder of that vocabulary; it outlives the task."""
    key = vocabulary.name, keep_ids
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, keep_ids)
    return _encoders[key]


class Encoder:
    """Encodes batches of texts; remembers a bounded number of distinct pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, keep_ids: bool):
        self.v, self.keep_ids = vocabulary, keep_ids
        self.short = Places()  # places of the remembered pre-tokens: of those up to SHORT,
        self.known: dict[str, int] = {}  # and of the others
        self.edges = np.zeros(1, np.int64)  # where the ids of each place begin, and the last end
        self.ids = np.zeros(0, np.int32)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each pre-token (flat), and how many."""
        v = self.v
        lengths = np.array([len(t) for t in tokens], np.int64)
        symbols = v.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)].astype(np.int64)
        rows = np.repeat(np.arange(len(tokens)), lengths)
        pair = np.full(len(symbols), _NONE)  # rank of each symbol with the next one
        near = np.flatnonzero(rows[:-1] == rows[1:])
        pair[near] = v.rank(symbols[near] * v.size + symbols[near + 1])
        done_rows, done_symbols = [], []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            lowest = np.minimum.reduceat(pair, heads)
            spread = np.repeat(lowest, np.diff(np.append(heads, len(rows))))
            ready = spread == _NONE
            if ready.any():
                done_rows.append(rows[ready])
                done_symbols.append(symbols[ready])
                going = np.flatnonzero(~ready)
                symbols, rows, pair, spread = symbols[going], rows[going], pair[going], spread[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(pair == spread)
            follows = np.concatenate([[False], at[1:] == at[:-1] + 1])
            if follows.any():  # places of one pair that overlap: every other one, from the left
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(follows, 0, place))
                at = at[(place - first) % 2 == 0]
            symbols[at] = v.merged[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            kept = np.flatnonzero(keep)
            symbols, rows, pair = symbols[kept], rows[kept], pair[kept]
            at -= np.arange(len(at))  # where the new symbols are now; only pairs with one of them are others
            pair[at] = _NONE
            near = np.concatenate([at[at > 0] - 1, at[at + 1 < len(rows)]])
            near = near[rows[near] == rows[near + 1]]
            pair[near] = v.rank(symbols[near] * v.size + symbols[near + 1])
        if not done_rows:
            return np.zeros(0, np.int32), np.zeros(len(tokens), np.int64)
        rows, symbols = np.concatenate(done_rows), np.concatenate(done_symbols)
        order = np.argsort(rows, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(rows, minlength=len(tokens)).astype(np.int64)

    def _look_up(self, distinct: list[str], short: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Place of each distinct pre-token (of the short ones: those not remembered), and where ids begin in which array."""
        at = np.full(len(distinct), -1, np.int64)
        for i in np.flatnonzero(~short).tolist():
            at[i] = self.known.get(distinct[i], -1)
        new = np.flatnonzero(at < 0)
        long = np.array([len(distinct[i]) > LONG for i in new.tolist()], bool)
        new = np.concatenate([new[~long], new[long]])
        edges, ids = self.edges, self.ids
        if len(new):
            made, n = self.merge([distinct[i].encode() for i in new.tolist()])
            at[new] = len(edges) - 1 + np.arange(len(new))
            edges = np.concatenate([edges, edges[-1] + np.cumsum(n)])
            if self.keep_ids:
                ids = np.concatenate([ids, made])
            keep = min(int((~long).sum()), REMEMBER - (len(self.edges) - 1))
            if keep > 0:
                kept = new[:keep]
                some = kept[short[kept]]
                self.short.add(low[some], high[some], at[some])
                self.known.update((distinct[i], int(at[i])) for i in kept[~short[kept]].tolist())
                self.edges = edges[: len(self.edges) + keep]
                self.ids = ids[: int(self.edges[-1])] if self.keep_ids else ids
        return at, edges, ids

    def _find(self, text: str, points: np.ndarray, raw: np.ndarray, starts: np.ndarray):
        """Place of each pre-token, and where ids begin in which array. ``raw``: the UTF-8 bytes of ``points``."""
        if len(raw) == len(points):
            at = np.append(starts, len(raw))
        else:
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[np.append(starts, len(points))]
        size = np.diff(at)
        short = size <= SHORT
        low, high = packed(raw, at[:-1], size)
        places = np.where(short, self.short.find(low, high), -1)
        left = np.flatnonzero(places < 0)
        if not len(left):
            return places, self.edges, self.ids
        ends = np.append(starts[1:], len(points))[left]
        starts = starts[left]
        if len(left) < len(places):
            n = ends - starts
            own_ends = np.cumsum(n)
            points = points[np.repeat(starts - (own_ends - n), n) + np.arange(own_ends[-1])]
            text, starts, ends = points.tobytes().decode("utf-32-le"), own_ends - n, own_ends
        first, back = self._distinct(text, points, starts, ends)
        of = left[first]
        found, edges, ids = self._look_up([text[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], short[of], low[of], high[of])
        places[left] = found[back]
        return places, edges, ids

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """Code points of rows of UTF-8 bytes, cut into segments at special strings.

        Gives the text, its segments' offsets, the row of each segment and the special id after it (-1: none).
        """
        text = data.tobytes().decode("utf-8")
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = lead[offsets]
        inner: list[tuple[int, int, int]] = []
        for special, number in self.v.specials.items():
            at = text.find(special)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(special) <= bounds[row + 1]:
                    inner.append((at, at + len(special), number))
                at = text.find(special, at + 1)
        if not inner:
            return text, bounds[:-1], bounds[1:], np.arange(len(bounds) - 1), np.full(len(bounds) - 1, -1)
        starts, ends, rows, after = [], [], [], []
        inner.sort(key=lambda x: (x[0], -x[1]))
        i = 0
        for row, (at, to) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            while i < len(inner) and inner[i][0] < to:
                s, e, number = inner[i]
                i += 1
                if s < at:
                    continue
                starts.append(at), ends.append(s), rows.append(row), after.append(number)
                at = e
            starts.append(at), ends.append(to), rows.append(row), after.append(-1)
        return text, np.array(starts), np.array(ends), np.array(rows), np.array(after)

    @staticmethod
    def _distinct(text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct pre-token, and which of them each pre-token is; hashes find them, code points decide."""
        _, first, back = np.unique(ragged.marks(points, starts, ends), return_index=True, return_inverse=True)
        wrong = np.flatnonzero(~ragged.same(points, starts, ends, first[back])) if len(first) else first
        others: dict[str, int] = {}
        extra: list[int] = []
        for i in wrong.tolist():
            x = text[starts[i] : ends[i]]
            if x not in others:
                others[x] = len(first) + len(extra)
                extra.append(i)
            back[i] = others[x]
        return np.concatenate([first, np.array(extra, np.int64)]), back

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids_too: bool = True):
        """Tokens of each row; with ``keep_ids`` and ``ids_too`` also all ids, row after row."""
        n = len(offsets) - 1
        text, seg_start, seg_end, seg_row, seg_after = self.split(data, offsets)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(seg_start) > n:  # leave special strings out
            kept = np.zeros(len(points) + 1, np.int64)
            np.add.at(kept, seg_start, 1)
            np.add.at(kept, seg_end, -1)
            inside = np.cumsum(kept)[:-1] > 0
            points = points[inside]
            text = points.tobytes().decode("utf-32-le")
            data = np.frombuffer(text.encode(), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(seg_end - seg_start)])
        starts = pre_tokens(points, bounds)
        places, edges, pool = self._find(text, points, data, starts)
        begins = edges[places]
        counts = edges[places + 1] - begins
        where = np.searchsorted(starts, bounds)
        sums = np.concatenate([[0], np.cumsum(counts)])
        seg_tokens = sums[where[1:]] - sums[where[:-1]] + (seg_after >= 0)
        row_tokens = np.bincount(seg_row, weights=seg_tokens, minlength=n).astype(np.int64) if len(seg_row) else np.zeros(n, np.int64)
        if not (self.keep_ids and ids_too):
            return row_tokens, None
        total = int(sums[-1])
        ids = pool[np.repeat(begins - sums[:-1], counts) + np.arange(total)] if total else np.zeros(0, np.int32)
        if (seg_after >= 0).any():
            use = np.flatnonzero(seg_after >= 0)
            ids = np.insert(ids, sums[where[1:]][use], seg_after[use].astype(np.int32))
        return row_tokens, ids
