"""Mixing sources to target weights (operator 6): soft membership and projected-gradient least squares.

A classifier fitted on a labelled table gives each document a posterior p_d over domains. Documents get nonnegative rates
r_d whose expected domain token totals S_k = sum r_d n_d p_dk shall equal targets T_k. In shares of all tokens, rates
minimise |s - t|^2 + ridge * (weighted mean of (r_d - 1)^2) under r >= 0; the ridge chooses among the many rates that meet
the targets those nearest to 1. A projected gradient step is r_d <- max(0, 1 + p_d' x) with x moved against the slope
s - t + ridge * x, scaled by the curvature of the documents whose rate is above 0 (projected Newton), and halved when the
objective would rise. A step needs one distributed sum of a few numbers per domain, and the rates are never stored: a
document's rate follows from its posterior and x.

The ridge falls tenfold from ``RIDGE`` as long as the totals come at least twice as near. Targets that no mix of these
documents can meet, such as none of a domain that every document belongs to a little, end that; ``Mix.met`` says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import ragged
from plotweave.llm.common import Scratch

#: Labelled rows per domain that the classifier is fitted on (about; chosen by a hash of the id).
SAMPLE_ROWS = 800
#: Sampled documents that must hold a word or word beginning for it to be a feature, and the features kept.
LEAST_DOCUMENTS, FEATURES = 6, 4096
#: Lengths (bytes) of the word beginnings that count as features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: The first ridge, and the error of the totals (share of all tokens) with which targets are met.
RIDGE, TOLERANCE = 1e-3, 1e-5
#: Steps with one ridge before the fit gives up.
STEPS = 60
#: Shape features beside the words.
SHAPES = 8


def shapes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Per row: shares of capitals, punctuation, digits, other scripts and line ends, word length, repeats, log words."""
    n = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    words = ragged.per_row(starts, offsets)
    row = np.repeat(np.arange(n), words)
    again = np.zeros(len(marks))
    again[1:] = (marks[1:] == marks[:-1]) & (row[1:] == row[:-1])
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    sign = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    some = np.maximum(words, 1)
    return np.stack(
        [
            per_row(upper) / size,
            per_row(sign) / size,
            per_row(digit) / size,
            per_row(data >= 128) / size,
            per_row(data == 10) / size,
            np.bincount(row, weights=ends - starts, minlength=n) / some / 10,
            np.bincount(row, weights=again, minlength=n) / some,
            np.log1p(words) / 10,
        ],
        axis=1,
    )


_PLAIN = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def marks_of(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (without punctuation) and of the beginnings of longer ones, and their rows."""
    starts, ends = ragged.runs(_PLAIN[low], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), ragged.per_row(starts, offsets))
    every, rows = [ragged.hashes(low, starts, ends)], [row]
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts > n)
        with np.errstate(over="ignore"):
            every.append(ragged.hashes(low, starts[at], starts[at] + n) * np.uint64(2 * n + 1))
        rows.append(row[at])
    return np.concatenate(every), np.concatenate(rows)


@dataclass
class Classifier:
    """Multinomial logistic regression on the presence of words and word beginnings, and on shapes."""

    domains: list[str]
    keys: np.ndarray
    weights: np.ndarray  # words + SHAPES + 1 rows
    shape_mean: np.ndarray
    shape_scale: np.ndarray

    def __post_init__(self):
        self.table = ragged.HashTable(self.keys)

    def features(self, data: np.ndarray, offsets: np.ndarray):
        """Words per row, (row, word) pairs without repeats, and scaled shapes with a constant."""
        low, starts, ends, marks = ragged.words(data, offsets)
        words = ragged.per_row(starts, offsets)
        every, rows = marks_of(low, offsets)
        at = self.table.find(every)
        hit = at >= 0
        pairs = np.unique(rows[hit] * max(len(self.keys), 1) + at[hit])
        shape = (shapes(data, offsets, starts, ends, marks) - self.shape_mean) / self.shape_scale
        return words, pairs // max(len(self.keys), 1), pairs % max(len(self.keys), 1), np.column_stack([np.clip(shape, -5, 5), np.ones(len(words))])

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and domain posteriors of each row."""
        words, row, word, dense = self.features(data, offsets)
        score = dense @ self.weights[len(self.keys) :]
        for k in range(len(self.domains)):
            score[:, k] += np.bincount(row, weights=self.weights[word, k], minlength=len(words))
        score = np.exp(score - score.max(axis=1, keepdims=True)) if len(self.domains) else score
        return words, score / score.sum(axis=1, keepdims=True) if len(self.domains) else score


def train(docs: DataFrame, labels: DataFrame, domain, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on about ``rows`` labelled documents per domain; ``domain`` is a column of ``labels`` (null: no label).

    An id with several labels counts with its alphabetically first domain, one that several documents have with the text
    that comes first. The sampled labels, whose number is bounded by ``rows`` and the number of domains, are broadcast to
    the documents; only the sampled texts come to the driver.
    """
    known = labels.select(F.col(id_col).alias("__id"), domain.cast("string").alias("__domain")).where("__id IS NOT NULL AND __domain IS NOT NULL").groupBy("__id").agg(F.min("__domain").alias("__domain"))
    counts = {r[0]: r[1] for r in known.groupBy("__domain").count().collect()}
    domains = sorted(counts)
    if not domains:
        return Classifier([], np.zeros(0, np.uint64), np.zeros((SHAPES + 1, 0)), np.zeros(SHAPES), np.ones(SHAPES))
    part = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    draw = F.shiftrightunsigned(F.xxhash64(F.col("__id"), F.lit(6)), 11) / F.lit(float(1 << 53))
    chosen = known.where(draw < part[F.col("__domain")])
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    sample = found.groupBy("__id").agg(F.min("__text").alias("__text"), F.min("__domain").alias("__domain")).select("__text", "__domain").toArrow()
    data, offsets = ragged.utf8(sample.column(0))
    label = np.array([domains.index(x) for x in sample.column(1).to_pylist()], np.int64)
    keys = _informative(data, offsets, label, len(domains))
    model = Classifier(domains, keys, np.zeros((len(keys) + SHAPES + 1, len(domains))), np.zeros(SHAPES), np.ones(SHAPES))
    raw = _in_blocks(model, data, offsets)[2][:, :SHAPES]
    model.shape_mean, model.shape_scale = raw.mean(axis=0) if len(raw) else raw.sum(axis=0), np.maximum(raw.std(axis=0), 1e-3) if len(raw) else np.ones(SHAPES)
    row, word, dense = _in_blocks(model, data, offsets)
    _descend(model, label, row, word, dense, np.array([counts[d] for d in domains], float))
    return model


def _in_blocks(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all rows, worked out for a block of texts at a time."""
    rows, words, dense = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, SHAPES + 1))]
    for a, b in ragged.blocks(offsets, 1 << 20):
        _, row, word, shape = model.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rows.append(row + a)
        words.append(word)
        dense.append(shape)
    return np.concatenate(rows), np.concatenate(words), np.concatenate(dense)


def _informative(data: np.ndarray, offsets: np.ndarray, label: np.ndarray, domains: int) -> np.ndarray:
    """The features whose presence differs most between a domain and the rest, in standard errors."""
    marks, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in ragged.blocks(offsets, 1 << 20):
        every, row = marks_of(ragged.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        order = np.lexsort((every, row))
        every, row = every[order], row[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (row[1:] != row[:-1])
        marks.append(every[new])
        labels.append(label[row[new] + a])
    every, of = np.concatenate(marks), np.concatenate(labels)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    held = np.stack([np.add.reduceat((of == k).astype(np.int32), first) if len(first) else np.zeros(0, np.int32) for k in range(domains)], axis=1)
    keys, often = every[first], held.sum(axis=1)
    keys, held, often = keys[often >= LEAST_DOCUMENTS], held[often >= LEAST_DOCUMENTS], often[often >= LEAST_DOCUMENTS]
    size = np.bincount(label, minlength=domains)
    rest, others = np.maximum(len(label) - size, 1), often[:, None] - held
    p, q, whole = held / np.maximum(size, 1), others / rest, (often / max(len(label), 1))[:, None]
    error = np.sqrt(whole * (1 - whole) * (1 / np.maximum(size, 1) + 1 / rest) + 1e-12)
    return keys[np.sort(np.argsort(-(np.abs(p - q) / error).max(axis=1, initial=0), kind="stable")[:FEATURES])]


def _descend(model: Classifier, label: np.ndarray, row: np.ndarray, word: np.ndarray, dense: np.ndarray, prior: np.ndarray, steps: int = 400, penalty: float = 2e-4) -> None:
    """Full-batch Adam on the cross-entropy, with each domain weighted to its share among all labels."""
    n, k, m = len(label), len(model.domains), len(model.keys)
    if not n:
        return
    share = prior / prior.sum() / np.maximum(np.bincount(label, minlength=k), 1)
    weight = share[label][:, None]
    truth = np.eye(k)[label]
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        score = dense @ model.weights[m:]
        for j in range(k):
            score[:, j] += np.bincount(row, weights=model.weights[word, j], minlength=n)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = weight * (p / p.sum(axis=1, keepdims=True) - truth)
        gradient = np.empty_like(model.weights)
        gradient[m:] = dense.T @ error
        for j in range(k):
            gradient[:m, j] = np.bincount(word, weights=error[row, j], minlength=m)
        gradient += penalty * model.weights / 10
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        model.weights -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)


def rates(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors ``p``."""
    return np.maximum(0.0, 1 + p @ x)


def _rate(x: np.ndarray):
    """The same as a column over ``p``."""
    return F.greatest(F.lit(0.0), sum((F.col("p")[k] * float(v) for k, v in enumerate(x)), F.lit(1.0)))


def copies(rate, draw, snap: float = 0.0):
    """Whole numbers whose mean is the rate: its floor, plus one where the draw (0 to 1) falls below the rest.

    Rates within ``snap`` of a whole number count as it, so that soft memberships do not drop or repeat rows by chance; what
    that does to the totals is in ``totals``.
    """
    whole = F.round(rate)
    return F.floor(F.when(F.abs(rate - whole) <= snap, whole).otherwise(rate) + draw).cast("long")


def _draw(id_col: str, text_col: str, seed: int):
    """A number from 0 to 1 by id and text; rows that repeat both share it."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 11) / F.lit(float(1 << 53))


@dataclass
class Mix:
    """A fitted mix: what is needed to give any document its rate."""

    classifier: Classifier
    x: np.ndarray
    targets: np.ndarray  # token totals
    reached: np.ndarray  # expected token totals
    ridge: float = 0.0
    met: bool = True  # whether the totals are the targets, to within TOLERANCE of all tokens


def posteriors(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``id`` (or the columns ``carry``), ``n_tokens, p array<double>`` for each row; tokens are words between white space, null texts have none."""
    names = [id_col] if carry is None else list(carry)
    source = docs.select(F.col(text_col).alias("__classified"), *names)
    held = docs.sparkSession.sparkContext.broadcast(classifier)
    k = len(classifier.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ragged.utf8(batch.column(0))
            for a, b in ragged.blocks(offsets):
                n, p = held.value.posteriors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * k), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)), pa.array(n.astype(np.int64)), lists], names=[*names, "n_tokens", "p"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{fields}, n_tokens long, p array<double>")


def _sums(table: DataFrame, k: int, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows, with their rates at x: tokens, expected totals by domain, their curvature, and the part of the objective."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total, square, half = 0.0, np.zeros(k), np.zeros((k, k)), 0.0
        for batch in batches:
            n = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(len(n), k)
            r = rates(p, x)
            free = p[r > 0]
            tokens += n.sum()
            total += (r * n) @ p
            square += (free * n[r > 0][:, None]).T @ free
            half += float(n @ r**2) / 2
        yield pa.RecordBatch.from_arrays([pa.array([[tokens, *total, *square.ravel(), half]], pa.list_(pa.float64()))], names=["s"])

    parts = table.select("n_tokens", "p").mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    found = np.array([r.v for r in parts]) if parts else np.zeros(2 + k + k * k)
    return float(found[0]), found[1 : 1 + k], found[1 + k : -1].reshape(k, k), float(found[-1])


def solve(sums, k: int, targets, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]:
    """x, targets, totals, the ridge and whether the targets are met. ``sums(x)`` as ``_sums``; ``targets`` of the totals at rates of 1."""
    x = np.zeros(k)
    tokens, total, square, half = sums(x)
    wanted = targets(total)
    if not tokens:
        return x, wanted, total, 0.0, True
    t, now = wanted / tokens, RIDGE
    best = None
    while True:
        for _ in range(STEPS):
            slope = total / tokens - t + now * x
            if np.abs(slope).sum() <= TOLERANCE / 100:
                break
            value = half / tokens + now * (x @ x) / 2 - t @ x
            step = np.linalg.solve(square / tokens + now * np.eye(k), slope)
            ahead = slope @ step
            for cut in range(30):
                trial = sums(x - step / 2**cut)
                y = x - step / 2**cut
                if trial[3] / tokens + now * (y @ y) / 2 - t @ y <= value - 1e-4 * ahead / 2**cut + 1e-15:
                    break
            x, (_, total, square, half) = y, trial
        else:
            raise RuntimeError("the fit of the rates did not settle")
        gap = float(np.abs(total / tokens - t).sum())
        if best is not None and gap > best[3] / 2:
            return *best[:3], now * 10, False
        best = x, wanted, total, gap
        if gap <= TOLERANCE or now <= ridge * (1 + 1e-9):
            return x, wanted, total, now, gap <= TOLERANCE
        now /= 10


def fit(posterior_table: DataFrame, classifier: Classifier, weights: dict[str, float], relative: bool = False, ridge: float = 0.0) -> Mix:
    """Fit rates to domain weights; ``relative`` weights are factors on the domains' present token totals.

    Absolute weights are shares (scaled to sum to 1) of the largest total for which no domain must be repeated. The ridge
    does not fall below ``ridge``.
    """
    k = len(classifier.domains)
    if not k:
        return Mix(classifier, np.zeros(0), np.zeros(0), np.zeros(0))
    asked = np.array([weights.get(d, 0.0) for d in classifier.domains], float)

    def targets(now: np.ndarray) -> np.ndarray:
        if relative:
            return now * asked
        share = asked / asked.sum()
        return share * min((now[i] / share[i] for i in range(k) if share[i] > 0), default=0.0)

    return Mix(classifier, *solve(lambda x: _sums(posterior_table, k, x), k, targets, ridge))


def mix(docs: DataFrame, labels: DataFrame, domain, weights: dict[str, float], relative: bool = False, seed: int = 0, snap: float = 0.0, ridge: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[Mix, DataFrame]:
    """The fitted mix, and ``id, n_tokens, p, rate, copies`` for each row of ``docs``.

    Every row gives one row: null and empty texts have no tokens and the posterior of an empty text; rows that repeat an
    id and a text get the same numbers; without labels there is no domain, all rates are 1. Other columns are not read.
    """
    classifier = train(docs, labels, domain, id_col=id_col, text_col=text_col)
    source = docs.select(id_col, F.col(text_col).alias("__text"), _draw(id_col, text_col, seed).alias("__draw"))
    table = Scratch(docs.sparkSession, "mixing").save(posteriors(source, classifier, id_col, "__text", (id_col, "__draw")), "posteriors")
    fitted = fit(table, classifier, weights, relative, ridge)
    rated = table.withColumn("rate", _rate(fitted.x))
    return fitted, rated.select(id_col, "n_tokens", "p", "rate", copies(F.col("rate"), F.col("__draw"), snap).alias("copies"))


def totals(mixed: DataFrame, fitted: Mix) -> DataFrame:
    """``domain, target, expected, realised`` token totals of what ``mix`` gave: the last with the whole copies."""
    k = len(fitted.classifier.domains)
    part = lambda i, often: F.sum(F.col(often) * F.col("n_tokens") * F.col("p")[i])
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(float(fitted.targets[i])).alias("target"), part(i, "rate").alias("expected"), part(i, "copies").alias("realised")) for i, d in enumerate(fitted.classifier.domains)])
    return mixed.agg(rows.alias("r")).select(F.inline("r")) if k else mixed.sparkSession.createDataFrame([], "domain string, target double, expected double, realised double")


def repeat_rows(
    docs: DataFrame, labels: DataFrame, domain, weights: dict[str, float], relative: bool = False, seed: int = 0, snap: float = 0.0, ridge: float = 0.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as ``mix`` says (not at all included).

    The rows are written once with their posteriors, so the texts are classified once.
    """
    classifier = train(docs, labels, domain, id_col=id_col, text_col=text_col)
    scratch = Scratch(docs.sparkSession, "mixing")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("__text"), _draw(id_col, text_col, seed).alias("__draw"))
    marked = posteriors(packed.select("row", "__draw", "__text"), classifier, "row", "__text", ("row", "__draw"))
    table = scratch.save(marked, "posteriors")
    fitted = fit(table, classifier, weights, relative, ridge)
    often = copies(_rate(fitted.x), F.col("__draw"), snap).cast("int")
    kept = table.select("row", often.alias("often")).where("often > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("often")))).select("row.*")
