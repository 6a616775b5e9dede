"""Vectorised handling of many texts at once, as flat numpy arrays with offsets.

A column of texts is one byte array plus row offsets; tokens are (start, end) pairs into it. A token's hash is computed
for all tokens together from prefix sums, so no Python object exists per token: two polynomials modulo primes of 31 bits
give 62 bits, and no family of texts is known to collide (modulo 2^64 the words of Thue and Morse do). Two given tokens
agree by chance with a probability near 2^-62; who needs certainty compares the bytes (``same``), as the tokenizer does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer single text is handled alone.
BLOCK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Values hashed together.
PIECE = 1 << 18
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515249, 1999999973)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of a base and of its inverse."""
    if which not in _tables or len(_tables[which][0]) < n:
        p, base = _PRIMES[which], _BASES[which]
        made = []
        for b in (base, pow(base, -1, p)):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, PIECE + 1):
                out = np.concatenate([out, out * np.uint64(pow(b, len(out), p)) % np.uint64(p)])
            made.append(out)
        _tables[which] = made[0], made[1]
    return _tables[which]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes together, or are one long row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row boundaries."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~inside[:-1]
    cuts = offsets[offsets < n]
    first[cuts] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~inside[1:]
    cuts = offsets[offsets > 0] - 1
    last[cuts] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of tokens in each row."""
    at = np.searchsorted(starts, offsets)
    return np.diff(at)


def _hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, parts = len(values), []
    plus = values.astype(np.uint64) + np.uint64(1)
    for which, prime in enumerate(_PRIMES):
        p, (power, inverse) = np.uint64(prime), _powers(which, n)
        terms = plus * power[:n]
        if values.dtype != np.uint8 or n > 1 << 24:  # else the sums fit without
            terms %= p
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(terms, out=sums[1:])
        parts.append((sums[ends] - sums[starts]) % p * inverse[starts] % p)
    h = (parts[0] << np.uint64(31)) | parts[1]
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice of ``values`` (bytes or code points), in order of place; equal slices have equal hashes anywhere."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        out[i:j] = _hash(values[low : int(ends[j - 1])], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


_wrapping: list[np.ndarray] = []


def _wrapping_powers() -> list[np.ndarray]:
    """Powers modulo 2^64 of an odd base and of its inverse, for one piece."""
    if not _wrapping:
        with np.errstate(over="ignore"):
            for base in (int(_MIX), pow(int(_MIX), -1, 1 << 64)):
                steps = np.full(PIECE + 1, base, np.uint64)
                steps[0] = 1
                _wrapping.append(np.multiply.accumulate(steps))
    return _wrapping


def marks(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cheaper hashes, for who compares the values behind them (``same``): one polynomial modulo 2^64.

    Equal slices have equal marks within one call. Long slices can be made to collide, which costs time and nothing else.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    power, inverse = _wrapping_powers()
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            j = int(np.searchsorted(ends, low + PIECE, "right"))
            if j <= i:  # longer than a piece
                whole = values[low : int(ends[i])]
                out[i] = int.from_bytes(hashlib.blake2b(whole.tobytes(), digest_size=8).digest(), "little")
                i += 1
                continue
            high = int(ends[j - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((values[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * inverse[starts[i:j] - low]
            i = j
    return out


def same(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each slice (in order of place, without gaps or with) has the values of slice number ``other`` of them."""
    size = ends - starts
    equal = size == size[other]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, int(starts[i]) + PIECE, "right")))
        some = np.flatnonzero(equal[i:j]) + i
        n = size[some]
        at = np.cumsum(n) - n
        places = np.arange(int(n.sum()))
        differ = values[np.repeat(starts[some] - at, n) + places] != values[np.repeat(starts[other[some]] - at, n) + places]
        if differ.any():
            equal[some[np.searchsorted(at, np.flatnonzero(differ), "right") - 1]] = False
        i = j
    return equal


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, and starts, ends and hashes of the words between ASCII white space."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], offsets)
    return low, starts, ends, hashes(low, starts, ends)


class HashTable:
    """Fixed 64-bit keys to positions 0..n-1, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bits = max(1, int(np.ceil(np.log2(max(2, 2 * len(keys))))))
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        slot = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, to = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < to)
        for _ in range(self.longest):
            if not len(left):
                break
            pos = at[left]
            hit = self.keys[pos] == wanted[left]
            out[left[hit]] = self.order[pos[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < to[left]]
        return out


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of UTF-8 bytes as an Arrow string column, without a Python object per slice."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.string())
