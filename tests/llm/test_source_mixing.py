import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import queries, source_mixing
from plotweave.llm.common import read_table
from tests.llm.helpers import awkward, documents


def tables(spark):
    rng = np.random.default_rng(1)
    kinds = {"a": ["ship", "sail", "mast", "wave"], "b": ["king", "crown", "court", "sword"], "c": ["seed", "root", "leaf", "soil"]}
    texts, names = [], []
    for i in range(240):
        kind = "abc"[min(i % 5, 2)]
        texts.append(" ".join(rng.choice([*kinds[kind], "the", "and", "of"], 20 + i % 30)))
        names.append(kind)
    labels = spark.createDataFrame([(i, names[i]) for i in range(0, 240, 2)] + [(None, "a"), (3, None), (9999, "b"), (0, names[0])], "doc_id long, kind string")
    return documents(spark, texts + awkward(), extra=("p", "rate")), labels, names, texts


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.0, "b": 0.5, "c": 0.5}, {"b": 1.0}])
def test_totals_meet_targets(spark, weights):
    docs, labels, names, texts = tables(spark)
    fitted, mixed = source_mixing.mix(docs, labels, F.col("kind"), weights)
    assert fitted.classifier.domains == ["a", "b", "c"]
    rows = sorted(mixed.collect())
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    assert sum("abc"[int(np.argmax(r.p))] == k for r, k in zip(rows, names, strict=False)) > 230
    assert [r.n_tokens for r in rows[:240]] == [len(t.split()) for t in texts]
    total = np.array([np.array(r.p) * r.n_tokens * r.rate for r in rows]).sum(axis=0)
    assert np.allclose(total, fitted.reached)
    # the whole fit again, by a solver that knows nothing of steps: least squares over the rates themselves
    p, n, rate = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    def objective(r, ridge):
        return (np.square((r * n) @ p - fitted.targets).sum() / n.sum() + ridge * (n @ np.square(r - 1))) / n.sum()

    assert objective(rate, fitted.ridge) <= objective(brute_rates(p, n, fitted.targets, fitted.ridge), fitted.ridge) * (1 + 1e-6) + 1e-12
    stiff = np.array([r.rate for r in sorted(source_mixing.mix(docs, labels, F.col("kind"), weights, ridge=1e-3)[1].collect())])
    want = brute_rates(p, n, fitted.targets, 1e-3)
    assert np.abs(stiff - want)[n > 0].max() < 0.01
    assert fitted.met == (np.abs(total - fitted.targets).sum() <= source_mixing.TOLERANCE * n.sum())
    report = {r.domain: r for r in source_mixing.totals(mixed, fitted).collect()}
    often = np.array([r.copies for r in rows])
    for i, d in enumerate("abc"):
        assert report[d].target == pytest.approx(fitted.targets[i]) and report[d].expected == pytest.approx(total[i]) and report[d].realised == pytest.approx(float((often * n) @ p[:, i]))
    if min(weights.get(d, 0) for d in "abc") > 0:  # weights that soft memberships can reach
        assert fitted.met
        for d, w in zip("abc", total / total.sum(), strict=True):
            assert w == pytest.approx(weights[d], abs=1e-4)
    # whole copies have the rate as their mean
    assert abs(sum(r.copies for r in rows) - sum(r.rate for r in rows)) < 30


def brute_rates(p, n, targets, ridge):
    """Nonnegative least squares over one variable per row, by coordinate descent."""
    w = n / n.sum()
    rows = np.vstack([p.T * w, np.diag(np.sqrt(ridge * w))])
    right = np.concatenate([targets / n.sum(), np.sqrt(ridge * w)])
    gram, slope, r = rows.T @ rows, rows.T @ right, np.ones(len(n))
    gradient = gram @ r - slope
    for _ in range(4000):
        moved = 0.0
        for i in np.flatnonzero(n > 0):
            new = max(0.0, r[i] - gradient[i] / gram[i, i])
            if new != r[i]:
                gradient += gram[:, i] * (new - r[i])
                moved = max(moved, abs(new - r[i]))
                r[i] = new
        if moved < 1e-7:
            break
    return r


def test_steps_settle_on_the_least_squares_solution():
    rng = np.random.default_rng(2)
    for seed in range(20):
        p = rng.dirichlet([0.3] * 4, 60)
        n = rng.integers(1, 100, 60).astype(float)
        wanted = rng.dirichlet([0.5] * 4) * n.sum()
        calls = []

        def sums(x, p=p, n=n, calls=calls):
            r = source_mixing.rates(p, x)
            calls.append(x)
            return n.sum(), (r * n) @ p, (p[r > 0] * n[r > 0][:, None]).T @ p[r > 0], float(n @ r**2) / 2

        x, _, total, ridge, met = source_mixing.solve(sums, 4, lambda now, wanted=wanted: wanted)
        assert len(calls) < 80
        r, slope = source_mixing.rates(p, x), p @ ((total - wanted) / n.sum()) + ridge * (source_mixing.rates(p, x) - 1)
        assert np.abs(np.where(r > 1e-9, slope, np.minimum(slope, 0))).max() < 1e-6, seed
        assert met == (np.abs(total - wanted).sum() <= source_mixing.TOLERANCE * n.sum())


def test_repeat_rows_follows_the_rates(spark):
    docs, labels, _, _ = tables(spark)
    _, mixed = source_mixing.mix(docs, labels, F.col("kind"), {"a": 0.2, "b": 0.2, "c": 0.6}, seed=4)
    out = source_mixing.repeat_rows(docs, labels, F.col("kind"), {"a": 0.2, "b": 0.2, "c": 0.6}, seed=4)
    assert out.dtypes == docs.dtypes
    found = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {r.doc_id: r.copies for r in mixed.collect() if r.copies}


def test_columns_that_clash_are_kept(spark):
    docs, labels, _, _ = tables(spark)
    docs = docs.withColumns({"n_tokens": F.lit(1), "row": F.lit("x"), "often": F.lit(2)})
    out = source_mixing.repeat_rows(docs, labels, F.col("kind"), {"a": 1.0, "b": 1.0, "c": 1.0}, relative=True, snap=0.25)
    assert out.dtypes == docs.dtypes and out.count() == docs.count()


def test_copies_snap_to_whole_numbers(spark):
    table = spark.range(4000).select(F.element_at(F.array(*map(F.lit, (0.05, 0.95, 1.5, 2.08))), (F.col("id") % 4 + 1).cast("int")).alias("rate"), (F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)).alias("u"), "id")
    rows = table.select("id", source_mixing.copies(F.col("rate"), F.col("u")).alias("plain"), source_mixing.copies(F.col("rate"), F.col("u"), 0.1).alias("snapped")).orderBy("id").collect()
    plain, snapped = (np.array([r[name] for r in rows]).reshape(-1, 4) for name in ("plain", "snapped"))
    assert np.allclose(plain.mean(axis=0), [0.05, 0.95, 1.5, 2.08], atol=0.05)
    assert (snapped[:, [0, 1, 3]] == [0, 1, 2]).all() and set(snapped[:, 2].tolist()) == {1, 2}


def test_more_domains_than_a_byte_counts(spark):
    texts = [f"word{i % 300} word{i % 300} the of" for i in range(900)]
    labels = spark.createDataFrame([(i, f"d{i % 300:03d}") for i in range(900)], "doc_id long, kind string")
    model = source_mixing.train(documents(spark, texts), labels, F.col("kind"))
    assert len(model.domains) == 300 and model.weights.shape[1] == 300


def test_relative_weights_drop_a_domain_and_keep_the_rest(spark):
    docs, labels, names, _ = tables(spark)
    _, mixed = source_mixing.mix(docs, labels, F.col("kind"), {"a": 1.0, "b": 1.0, "c": 0.0}, relative=True)
    rows = sorted(mixed.collect())[:240]
    kept = {k: sum(r.copies for r, n in zip(rows, names, strict=True) if n == k) / names.count(k) for k in "abc"}
    assert kept["a"] > 0.9 and kept["b"] > 0.9 and kept["c"] < 0.1


def test_no_labels_and_no_rows(spark):
    docs, labels, _, _ = tables(spark)
    fitted, mixed = source_mixing.mix(docs, labels.limit(0), F.col("kind"), {"a": 1.0})
    assert all(r.rate == 1.0 and r.copies == 1 for r in mixed.collect())
    assert fitted.met and source_mixing.totals(mixed, fitted).count() == 0
    assert source_mixing.repeat_rows(docs, labels.limit(0), F.col("kind"), {"a": 1.0}).count() == docs.count()
    assert source_mixing.mix(docs.limit(0), labels, F.col("kind"), {"a": 1.0})[1].count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = source_mixing.train(docs, labels.where("doc_id % 8 <> 0"), F.expr(queries.DOMAIN))
    test = docs.join(labels.where("doc_id % 8 = 0").select("doc_id", F.expr(queries.DOMAIN).alias("domain")), "doc_id").select("doc_id", "text", "domain")
    want = {r.doc_id: r.domain for r in test.select("doc_id", "domain").collect()}
    got = {r.doc_id: model.domains[int(np.argmax(r.p))] for r in source_mixing.posteriors(test, model).collect()}
    right = sum(want[i] == got[i] for i in want) / len(want)
    toxic = [i for i in want if want[i] == "toxic"]
    caught, wrong = sum(got[i] == "toxic" for i in toxic), sum(got[i] == "toxic" for i in want if want[i] != "toxic")
    assert right > 0.9 and caught > 0.75 * len(toxic) and wrong < 0.02 * len(want), (right, caught / len(toxic), wrong / len(want))
