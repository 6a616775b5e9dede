import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import lm_scoring
from tests.llm.helpers import PROSE, awkward, documents

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), lm_scoring.END]


def corpus():
    words = [f"w{i}" for i in range(60)]
    return [" ".join(words[(i * j * j + j) % (i % 50 + 3)] for j in range(30)) for i in range(60)] + awkward()


def scored(spark, learn, others=(), **columns):
    """Rows of ``learn`` (by place), then those of ``others``."""
    docs = documents(spark, [*learn, *others], **columns)
    return lm_scoring.score_corpus(docs, F.col("doc_id") < len(learn)).orderBy("doc_id").collect()


@pytest.mark.parametrize(("head", "bucket"), [(1 << 18, 1 << 21), (6, 1 << 21), (1 << 18, 2000), (40, 500)])
def test_counts_and_base_score(spark, monkeypatch, head, bucket):
    """Whatever is sent as numbers, however many buckets there are, and with contexts dealt out over all of them."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "BLOCK", 1000)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", bucket)
    texts = corpus()
    learn, others = texts[::2], texts[1::2]
    seen = Counter(t for x in learn for t in tokens(x))
    total, types = sum(seen.values()), len(seen)
    rows = scored(spark, learn, others, extra=("score", "bucket", "payload"))
    assert len(rows) == len(texts)
    for r, text in zip(rows, [*learn, *others], strict=True):
        t = tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in seen for x in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[x] + 1) / (total + types + 1)) for x in t))
        assert math.isfinite(r.score) and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_buckets_change_little(spark, monkeypatch):
    learn = corpus()[:60]
    whole = sum(r.score for r in scored(spark, learn))
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 300)
    assert sum(r.score for r in scored(spark, learn)) == pytest.approx(whole, rel=0.03)


def test_same_result_again(spark):
    assert scored(spark, corpus()[:20]) == scored(spark, corpus()[:20])


def stirling(c, t, d):
    """Weight of all seatings of c customers at t tables."""
    if not c or not t:
        return float(c == t)
    return stirling(c - 1, t - 1, d) + (c - 1 - d * t) * stirling(c - 1, t, d)


def restaurant(counts, tables, base, d):
    """Weight of these table counts of all dishes of a restaurant."""
    out = math.prod(stirling(c, t, d) * b**t for c, t, b in zip(counts, tables, base, strict=True))
    return out * math.prod(lm_scoring.STRENGTH + d * j for j in range(sum(tables)))


@pytest.mark.parametrize("counts", [(5,), (3, 2, 1), (4, 4)])
def test_seating_has_the_exact_distribution(counts):
    """Table counts of all dishes of a restaurant, over many restaurants, against the sum over all their seatings."""
    d, base, many = 0.6, [0.3, 0.05, 0.2][: len(counts)], 20000
    weight = {t: restaurant(counts, t, base, d) for t in itertools.product(*(range(1, c + 1) for c in counts))}
    seating = lm_scoring.Seating(np.tile(counts, many), np.repeat(np.arange(many), len(counts)), many, d, np.random.default_rng(2))
    for _ in range(12):
        seating.sweep(np.tile(base, many))
    assert (np.bincount(seating.seat, minlength=len(seating.cell)) == seating.at_table).all()
    found = Counter(map(tuple, seating.tables().reshape(many, -1).tolist()))
    for t, w in weight.items():
        assert found[t] / many == pytest.approx(w / sum(weight.values()), abs=0.012)


def test_large_restaurants_in_slices(monkeypatch):
    """With several customers moving at once the mean number of tables stays that of one at a time."""
    rng = np.random.default_rng(3)
    n, base = rng.integers(1, 60, 400), np.full(400, 1 / 400)
    means = []
    for slices in (256, 1 << 15):
        monkeypatch.setattr(lm_scoring, "SLICES", slices)
        seating, total = lm_scoring.Seating(n, np.zeros(400, int), 1, 0.7, np.random.default_rng(4)), 0.0
        for step in range(30):
            seating.sweep(base)
            total += seating.tables().sum() * (step >= 10)
        assert (seating.tables() >= 1).all() and (seating.tables() <= n).all()
        again = lm_scoring.Seating(n, np.zeros(400, int), 1, 0.7, rng, seating.seats())
        assert (again.tables() == seating.tables()).all() and (again.seat == seating.seat).all()
        means.append(total / 20)
    assert means[0] == pytest.approx(means[1], rel=0.05)


def test_two_levels_against_all_seatings():
    """Three contexts that share a parent: predictions averaged over sweeps, as the operator takes them, against the sum over
    all table counts of both levels. The parent changes between sweeps only, so the agreement is not perfect."""
    cells = np.array([[3, 1, 0], [1, 2, 2], [0, 0, 2]])
    d, many, words = 0.5, 3000, 3
    h = (1 - lm_scoring.UNSEEN_BASE) / words
    want, total = np.zeros((3, words)), 0.0
    options = [range(1, c + 1) if c else range(1) for c in cells.ravel()]
    for t in itertools.product(*options):
        t = np.array(t).reshape(3, words)
        below = math.prod(restaurant(cells[u], t[u], np.ones(words), d) for u in range(3))
        c0 = t.sum(axis=0)
        for t0 in itertools.product(*(range(1, c + 1) for c in c0)):
            weight = below * restaurant(c0, t0, np.full(words, h), d) / math.prod(lm_scoring.STRENGTH + i for i in range(c0.sum()))
            parent = (c0 - d * np.array(t0) + (1 + d * sum(t0)) * h) / (1 + c0.sum())
            want += weight * (cells - d * t + (1 + d * t.sum(axis=1, keepdims=True)) * parent) / (1 + cells.sum(axis=1, keepdims=True))
            total += weight
    want /= total
    n, house = np.tile(cells.ravel(), many), np.repeat(np.arange(3 * many), words)
    lower = lm_scoring.Seating(n, house, 3 * many, d, np.random.default_rng(5))
    found = np.zeros((3, words))
    for step in range(14):
        c0 = lower.tables().reshape(many, 3, words).sum(axis=1)
        upper = lm_scoring.Seating(c0.ravel(), np.repeat(np.arange(many), words), many, d, np.random.default_rng(step))
        for _ in range(lm_scoring.PARENT_TURNS):
            upper.sweep(np.full(many * words, h))
        t0 = upper.tables().reshape(many, words)
        totals = [{"customers": c.sum(), "tables": t.sum(), "d": d, "types": words} for c, t in zip(c0, t0, strict=True)]
        base, less = (np.repeat(np.stack([f(c, t, of) for c, t, of in zip(c0, t0, totals, strict=True)]), 3, axis=0).ravel() for f in (lm_scoring._base, lm_scoring._base_less))
        held = np.bincount(house, weights=lower.tables(), minlength=3 * many)
        now = lm_scoring.predictive(n, lower.tables(), house, held, np.tile(cells.sum(axis=1), many), base, d).reshape(many, 3, words)
        unseen = (1 + d * held) / (1 + np.tile(cells.sum(axis=1), many)) * np.repeat([lm_scoring._base(np.zeros(1), np.zeros(1), of)[0] for of in totals], 3)
        assert np.allclose(now.sum(axis=2).ravel() + unseen, 1)
        if step >= 4:
            found += now.mean(axis=0) / 10
        lower.sweep(base, less)
    assert np.abs(found - want).max() < 0.02


def test_model_beats_base_on_held_out_text(spark):
    words = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(1)
    step = {i: rng.integers(0, 200, 3) for i in range(200)}

    def text():
        at, out = 0, []
        for _ in range(80):
            at = int(rng.choice(step[at]))
            out.append(words[at])
        return " ".join(out)

    rows = scored(spark, [text() for _ in range(200)], [text() for _ in range(30)])[200:]
    assert sum(r.score for r in rows) > 0.5 * sum(r.base_score for r in rows)


def test_all_contexts_keep_their_successors(spark):
    """2,000 contexts of one successor each, all equally frequent."""
    n = 2000
    follow = np.random.default_rng(3).permutation(n)
    right = [f"a{i} b{follow[i]}" for i in range(n)]
    wrong = [f"a{i} b{follow[(i + 1) % n]}" for i in range(n)]
    rows = scored(spark, right * 3, right + wrong)[3 * n :]
    assert all(rows[i].score > rows[n + i].score + 1 for i in range(n))


def test_documents_that_occur_twice_stand_out(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) if x < 5000) for _ in range(300)]
    rows = scored(spark, [*texts, *texts[:20]])
    mean = np.array([r.score / r.n_tokens for r in rows])
    twice = np.r_[0:20, 300:320]
    assert np.median(mean[twice]) > np.quantile(np.delete(mean, twice), 0.9)


def test_nothing_learned_and_nothing_scored(spark):
    docs = documents(spark, ["a b", None], ids=[1, 1])
    rows = lm_scoring.score_corpus(docs, F.lit(None).cast("boolean")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 0, 0), (3, 0, 0)]
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in rows)
    assert lm_scoring.score_corpus(documents(spark, []), F.lit(True)).count() == 0


def test_repeated_and_null_ids_each_give_their_row(spark):
    docs = documents(spark, [PROSE, "x", PROSE, None], ids=[None, None, 4, 4])
    rows = lm_scoring.score_corpus(docs, F.lit(True), also=("lang",)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.lang) for r in rows) == [("4", 1, "en"), ("4", 19, "en"), ("None", 2, "en"), ("None", 19, "en")]
