import random

import numpy as np
import pytest

from plotweave.llm import substring_dedup as s
from tests.llm.helpers import awkward, documents


def by_hand(rows, width):
    """(id, text) rows in the order that decides: words that stay, by comparing all windows."""
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for at in range(len(words) - width + 1):
            window = tuple(words[at : at + width])
            if window in seen:
                gone.update(range(at, at + width))
            seen.add(window)
        out.append((str(i), len(words), len(gone), b" ".join(w for n, w in enumerate(words) if n not in gone).decode()))
    return sorted(out)


def result(df, **options):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in s.remove_repeats(df, **options).collect())


def random_words(rng, n, kinds):
    return [rng.choice(kinds) for _ in range(n)]


def repeating(rng, rows, passages, kinds, size=60):
    """Texts out of random words, shared passages (whole, cut short or with a changed word) and runs of one word."""
    texts = []
    for _ in range(rows):
        words = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            part = list(rng.choice(passages))
            if kind < 0.3:
                part = random_words(rng, rng.randint(0, size), kinds)
            elif kind < 0.6:
                part = part[rng.randint(0, 8) : len(part) - rng.randint(0, 8)]
            elif kind < 0.7 and part:
                part[rng.randrange(len(part))] = "changed"
            elif kind < 0.8:
                part = [rng.choice(kinds)] * rng.randint(1, 50)
            words += part
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("kinds", [2, 3, 500])
@pytest.mark.parametrize("width", [1, 5, 20])
def test_same_as_all_windows(spark, kinds, width):
    rng = random.Random(100 * kinds + width)
    vocabulary = [f"w{i}" for i in range(kinds)]
    passages = [random_words(rng, rng.randint(10, 80), vocabulary) for _ in range(6)]
    texts = repeating(rng, 60, passages, vocabulary)
    df = documents(spark, texts, extra=("n_words", "tie", "id", "units")).repartition(7)
    assert result(df, width=width) == by_hand(list(enumerate(texts)), width)


def test_awkward_rows(spark):
    texts = [*awkward(), *awkward()]
    df = documents(spark, texts, extra=("start", "first")).repartition(5)
    assert result(df) == by_hand(list(enumerate(texts)), 20)


def test_ids_that_repeat_or_lack(spark):
    """Nulls come first; of rows with one id and text one keeps what it has; ids decide, not places."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    rows = [(5, a), (3, a), (None, b), (1, b), (7, "x " + a), (3, a), (3, a), (9, "one two"), (9, "one two"), (None, b)]
    out = s.remove_repeats(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]))
    found = sorted(((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out.collect()))
    want = [("None", 25, 0, b), ("None", 25, 25, ""), ("1", 25, 25, ""), ("3", 30, 0, a), ("3", 30, 30, ""), ("3", 30, 30, ""), ("5", 30, 30, ""), ("7", 31, 30, "x"), ("9", 2, 0, "one two"), ("9", 2, 0, "one two")]
    assert found == sorted(want)


def test_spans_are_what_went(spark):
    texts = [" ".join(f"w{i % 37}" for i in range(100)), "start " + " ".join(f"w{i % 37}" for i in range(40)) + " end"]
    for r in s.remove_repeats(documents(spark, texts)).collect():
        words = texts[r.doc_id].split()
        gone = {n for x in r.removed for n in range(x.start, x.end)}
        assert r.kept_text.split() == [w for n, w in enumerate(words) if n not in gone] and len(gone) == r.n_removed


def test_long_texts_are_parsed_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    passages = [random_words(rng, 70, [f"w{i}" for i in range(90)]) for _ in range(5)]
    long = " ".join(w for _ in range(60) for w in (*rng.choice(passages), *random_words(rng, 9, ["x", "y", "z"])))
    texts = [long, " ".join(passages[0]), long + " more"]
    want = by_hand(list(enumerate(texts)), 20)
    assert result(documents(spark, texts)) == want
    columns = s._unit_batches
    monkeypatch.setattr(s, "_unit_batches", lambda b, w, n: _small_pieces(columns, b, w, n))
    assert result(documents(spark, texts)) == want


def _small_pieces(run, batches, width, names):
    from plotweave.llm import substring_dedup

    substring_dedup.PIECE, before = 101, substring_dedup.PIECE
    try:
        yield from run(batches, width, names)
    finally:
        substring_dedup.PIECE = before


def test_joins_beyond_the_filter(spark, monkeypatch):
    texts = repeating(random.Random(3), 40, [[f"p{i}{j}" for j in range(50)] for i in range(4)], ["a", "b", "c"])
    monkeypatch.setattr(s.Filter, "fits", staticmethod(lambda n: False))
    assert result(documents(spark, texts)) == by_hand(list(enumerate(texts)), 20)


def test_contexts_decide_symbols():
    """A symbol of a stretch occurs in any text that holds its context, at the same place of it."""
    rng = np.random.default_rng(2)
    for kinds in (2, 4, 60):
        marks = s._mix(rng.integers(0, kinds, 400).astype(np.uint64))
        other = s._mix(np.concatenate([rng.integers(0, kinds, 57), np.zeros(300), rng.integers(0, kinds, 31)]).astype(np.uint64))
        other[57:357] = marks[50:350]
        one, two = (s.recompress(m, np.array([0, len(m)]), 3) for m in (marks, other))
        for (names, low, high), (names2, low2, high2) in zip(one, two, strict=True):
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
            there = {(int(a), int(b), int(n)) for a, b, n in zip(low2, high2, names2, strict=True)}
            inside = [(int(a), int(b), int(n)) for a, b, n in zip(low, high, names, strict=True) if a >= 50 and b <= 350]
            assert inside and all((a + 7, b + 7, n) in there for a, b, n in inside)


def test_equal_windows_pick_equal_contexts():
    rng = np.random.default_rng(7)
    shared = rng.integers(0, 50, 200)
    rows = [np.concatenate([rng.integers(0, 50, n), shared, rng.integers(0, 50, n)]) for n in (0, 13, 40)]
    marks, first = s._mix(np.concatenate(rows).astype(np.uint64)), np.cumsum([0, *map(len, rows)])
    keys = {}
    for row, start, count, key, _ in zip(*s.units(marks, first, 20), strict=True):
        for at in range(start, start + count):
            keys.setdefault(tuple(rows[row][at : at + 20].tolist()), set()).add(key)
    assert max(map(len, keys.values())) == 1 and len(keys) > 200


def test_names_by_brute_force():
    """One round against plain lists: runs first, then pairs of a left and a right symbol."""
    rng = np.random.default_rng(9)
    for _ in range(50):
        rows = [s._mix(rng.integers(0, 3, n).astype(np.uint64)) for n in rng.integers(0, 12, 3)]
        symbols = s.Symbols(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
        symbols.runs(1)
        runs = [sum(1 for i, x in enumerate(r) if i == 0 or r[i - 1] != x) for r in rows]
        assert np.bincount(symbols.row, minlength=3).tolist() == runs
        left = (s._mix(symbols.names + np.uint64(2)) >> np.uint64(63)).astype(bool)
        joined = sum(bool(left[i] and not left[i + 1] and symbols.row[i] == symbols.row[i + 1]) for i in range(len(left) - 1))
        before = len(left)
        symbols.pairs(2)
        assert len(symbols.names) == before - joined


def test_empty(spark):
    assert s.remove_repeats(documents(spark, [])).count() == 0
