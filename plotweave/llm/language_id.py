"""Language identification (operator 9): script ranges, then Viterbi over per-word scores.

A word is a run of letters of one script. Its script narrows the candidates to the languages that were learned with
it; its character bigrams and trigrams (with word edges) score those. The best labelling of all words of a text, where
each change of language costs ``switch``, gives labelled spans and, by letters, the language of the text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import bpe, ragged

#: Labelled rows per language that the model is fitted on (about; chosen by a hash of id and text).
SAMPLE_ROWS = 1500
#: Share of a language's letters from which on a script counts as its own.
SCRIPT_SHARE = 0.005
#: Bytes handled at a time.
BLOCK = 1 << 21

# Main letter ranges of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]

EDGE = np.uint64(1)
_WEIGHTS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_tables: list[np.ndarray] = []


def _characters() -> list[np.ndarray]:
    """For each code point its lower case, if that is one code point, and its script."""
    if not _tables:
        lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
        script = np.zeros(sys.maxunicode + 1, np.uint8)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = SCRIPT_NAMES.index(name)
        _tables.extend([lower, script])
    return _tables


@dataclass
class Words:
    """Words of rows of text: places (code points) and scripts, and the grams of the distinct ones."""

    starts: np.ndarray
    ends: np.ndarray
    row_at: np.ndarray  # first word of each row, and the end
    script: np.ndarray
    back: np.ndarray  # distinct word of each word
    distinct_script: np.ndarray
    grams: np.ndarray  # of all distinct words, one behind the other
    gram_at: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    lower, scripts = _characters()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = bpe.char_classes(points) == bpe.LETTER
    points, script = lower[points], scripts[points]
    change = np.flatnonzero(script[1:] != script[:-1]) + 1
    starts, ends = ragged.runs(letter, np.concatenate([bounds, change]))
    row_at = np.searchsorted(starts, bounds)
    marks = ragged.hashes(points, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    _, first, back = np.unique(marks, return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    # each distinct word between two edges
    width = size + 2
    at = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    flat = np.full(at[-1], EDGE, np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at[:-1] + 1, size) + inner] = points[np.repeat(starts[first], size) + inner]
    with np.errstate(over="ignore"):
        two = flat[:-1] * _WEIGHTS[0] + flat[1:] * _WEIGHTS[1] if len(flat) else flat
        three = two[:-1] + flat[2:] * _WEIGHTS[2] if len(flat) else flat
        mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        two, three = mix(two), mix(three + np.uint64(7))
    # a word of n letters has n + 1 bigrams and n trigrams
    both = np.empty(int((2 * size + 1).sum()), np.uint64)
    gram_at = np.concatenate([[0], np.cumsum(2 * size + 1)]).astype(np.int64)
    k = np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
    both[np.repeat(gram_at[:-1], size + 1) + k] = two[np.repeat(at[:-1], size + 1) + k] if len(k) else two[:0]
    both[np.repeat(gram_at[:-1] + size + 1, size) + inner] = three[np.repeat(at[:-1], size) + inner] if len(inner) else three[:0]
    return Words(starts, ends, row_at, script[starts], back, script[starts[first]], both, gram_at)


@dataclass
class Model:
    """Log-probabilities of grams by language, candidates by script."""

    languages: list[str]
    keys: np.ndarray
    scores: np.ndarray  # grams + 1 rows (the last: unseen), one column per language
    allowed: np.ndarray  # script by language
    prior: int

    def __post_init__(self):
        self.table = None

    def word_scores(self, w: Words) -> np.ndarray:
        """One row per distinct word. A script that no language was learned with gives no evidence."""
        if self.table is None:
            self.table = ragged.HashTable(self.keys)
        n = len(w.gram_at) - 1
        if not n:
            return np.zeros((0, len(self.languages)))
        at = self.table.find(w.grams)
        out = np.add.reduceat(self.scores[at], w.gram_at[:-1], axis=0)
        out /= np.sqrt(np.diff(w.gram_at))[:, None]
        fits = self.allowed[w.distinct_script]
        none = ~fits.any(axis=1)
        out[~fits] = -1e4
        out[none] = 0.0
        return out


def sample_labelled(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """About ``rows`` rows per language, chosen by a hash of id and text; nulls have no label."""
    labelled = docs.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return labelled.limit(0)
    part = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(9)), 11) / F.lit(float(1 << 53))
    return labelled.where(draw < part[F.col(lang_col)])


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of bounded size; grams are counted on the executors and only their totals come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                data, offsets = ragged.utf8(batch.column(0).filter(pa.array([x == lang for x in langs])))
                for a, b in ragged.blocks(offsets, BLOCK):
                    part = offsets[a : b + 1]
                    w = find_words(data[part[0] : part[-1]], part - part[0])
                    often = np.bincount(w.back, minlength=len(w.gram_at) - 1)
                    grams, back = np.unique(w.grams, return_inverse=True)
                    n = np.bincount(back, weights=np.repeat(often, np.diff(w.gram_at)), minlength=len(grams))
                    letters = np.bincount(w.script, weights=w.ends - w.starts, minlength=len(SCRIPT_NAMES))
                    kind = np.concatenate([np.zeros(len(grams), np.int32), np.ones(len(letters), np.int32)])
                    keys = np.concatenate([grams.view(np.int64), np.arange(len(letters))])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kind), pa.string()), pa.array(kind), pa.array(keys), pa.array(np.concatenate([n, letters]).astype(np.int64))], names=["lang", "kind", "gram", "n"])

    sample = sample_labelled(docs, rows, id_col, text_col, lang_col).select(text_col, F.col(lang_col).cast("string").alias("lang"))
    table = sample.mapInArrow(count, "lang string, kind int, gram long, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, gram, n = (table.column(c) for c in ("lang", "kind", "gram", "n"))
    kind, gram, n = kind.to_numpy(), gram.to_numpy(), n.to_numpy().astype(float)
    languages = sorted(set(lang.to_pylist()))
    which = np.array([languages.index(x) for x in lang.to_pylist()], np.int64)
    of = kind == 0
    keys, row = np.unique(gram[of].astype(np.int64).view(np.uint64), return_inverse=True)
    counts = np.zeros((len(keys) + 1, len(languages)))
    counts[row, which[of]] = n[of]
    scores = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(keys) + 1))) if languages else counts
    letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
    letters[gram[~of], which[~of]] = n[~of]
    allowed = letters > SCRIPT_SHARE * letters.sum(axis=0)
    return Model(languages, keys, scores, allowed, int(letters.sum(axis=0).argmax()) if languages else -1)


def viterbi(scores: np.ndarray, word: np.ndarray, row_at: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path of its row; all rows of a block advance together, word by word."""
    lengths = np.diff(row_at)
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], row_at[:-1][order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    labels = np.zeros(len(word), np.int64)
    stay = np.zeros((len(word), scores.shape[1]), bool)
    other = np.zeros(len(word), np.int64)
    best: np.ndarray | None = None
    last = np.zeros(len(lengths), np.int64)
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        now = scores[word[at]]
        if best is None:
            best = now
        else:
            if n < len(best):
                last[n : len(best)] = best[n:].argmax(axis=1)
                best = best[:n]
            top = best.argmax(axis=1)
            jump = best[np.arange(n), top] - switch
            hold = best >= jump[:, None]
            stay[at], other[at] = hold, top
            best = np.where(hold, best, jump[:, None]) + now
    if best is not None:
        last[: len(best)] = best.argmax(axis=1)
    state = last.copy()
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], other[at])
    return labels


def label(model: Model, data: np.ndarray, offsets: np.ndarray, switch: float):
    """Per row: language number (-1: no letter), share of letters, and spans as (row offsets, start, end, language)."""
    w = find_words(data, offsets)
    n, k = len(offsets) - 1, len(model.languages)
    if not len(w.starts) or not k:
        return np.full(n, -1), np.zeros(n), (np.zeros(n + 1, np.int32), *([np.zeros(0, np.int64)] * 3))
    labels = viterbi(model.word_scores(w), w.back, w.row_at, switch)
    row = np.repeat(np.arange(n), np.diff(w.row_at))
    size = (w.ends - w.starts).astype(float)
    known = model.allowed[w.script].any(axis=1)
    by = np.bincount(row * k + labels, weights=size * known, minlength=n * k).reshape(n, k)
    total = np.bincount(row, weights=size, minlength=n)
    best = by.argmax(axis=1)
    share = by[np.arange(n), best] / np.maximum(total, 1)
    best[(share == 0) & (total > 0)] = model.prior
    best[total == 0] = -1
    # spans: words of one label behind each other
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(labels)) - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets][:-1][row[first]]
    return best, share, (np.searchsorted(first, w.row_at).astype(np.int32), w.starts[first] - chars, w.ends[last] - chars, labels[first])


def identify(docs: DataFrame, model: Model, switch: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, spans array<struct<start, end, lang>>`` for each row of ``docs``.

    ``und`` with score 0 and no spans: a null or letterless text, or nothing was learned. Letters of a script that no
    language was learned with count against the score; a text of only such letters gets the language with most letters
    in training and score 0. Every row gives one row; no other column is read. There is no shuffle.
    """
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.languages, "und"], object)
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(1))
            for a, b in ragged.blocks(offsets, BLOCK):
                part = offsets[a : b + 1]
                best, share, (at, start, end, which) = label(held.value, data[part[0] : part[-1]], part - part[0], switch)
                inner = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(names[which], pa.string())], names=["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)], names=[id_col, "lang_pred", "score", "spans"])

    return source.mapInArrow(predict, f"`{id_col}` {id_type}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def keep_identified(docs: DataFrame, model: Model, least: float, switch: float = 12.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language by at least the share ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(place))
            for a, b in ragged.blocks(offsets, BLOCK):
                part = offsets[a : b + 1]
                best, share, _ = label(held.value, data[part[0] : part[-1]], part - part[0], switch)
                yield batch.slice(a, b - a).filter(pa.array((best >= 0) & (share >= least)))

    return docs.mapInArrow(keep, docs.schema)
