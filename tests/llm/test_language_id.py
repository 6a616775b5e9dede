import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plotweave.llm import language_id, queries, ragged
from plotweave.llm.common import read_table
from tests.llm.helpers import awkward, documents

EN = "the house and the garden were there when they went with the others through this wood"
DE = "der Hund und die Katze gingen durch den Wald und schliefen unter einem großen Baum"
RU = "мальчик и девочка пошли через лес к реке и долго смотрели на воду"


def corpus(spark):
    texts, langs = [EN, DE, RU, EN + " " + EN, DE + " " + DE, RU] * 3, ["en", "de", "ru"] * 6
    return documents(spark, texts, langs=langs)


def test_spans_of_mixed_text_and_edge_rows(spark):
    model = language_id.train(corpus(spark))
    mixed = EN + ". " + DE + "! " + RU
    texts = [mixed, None, "", "12 !?", "日本語", RU, *awkward()]
    rows = language_id.identify(documents(spark, texts, extra=("score", "lang_pred")), model).orderBy("doc_id").collect()
    spans = [(s.lang, mixed[s.start : s.end]) for s in rows[0].spans]
    assert [x[0] for x in spans] == ["en", "de", "ru"]
    assert spans[1][1] == DE and spans[2][1] == RU
    assert [(r.lang_pred, r.score) for r in rows[1:4]] == [("und", 0.0)] * 3
    assert rows[4].score == 0.0 and rows[4].lang_pred in model.languages
    assert (rows[5].lang_pred, rows[5].score) == ("ru", 1.0)
    assert all(0 <= r.score <= 1 for r in rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(7, 3)) * 3
    row_at = np.array([0, 5, 5, 11, 12])
    word = rng.integers(0, 7, 12)
    got = language_id.viterbi(scores, word, row_at, 2.0)

    def value(words, path):
        return sum(scores[w, p] for w, p in zip(words, path, strict=True)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

    for a, b in itertools.pairwise(row_at):
        best = max(value(word[a:b], p) for p in itertools.product(range(3), repeat=b - a))
        assert abs(value(word[a:b], got[a:b].tolist()) - best) < 1e-9


def test_grams_of_words():
    data, offsets = ragged.utf8(pa.array(["ab AB", "", "a1b", "жa"]))
    w = language_id.find_words(data, offsets)
    assert np.diff(w.row_at).tolist() == [2, 0, 2, 2]
    assert sorted(np.diff(w.gram_at).tolist()) == [3, 3, 3, 5]


def test_held_out_accuracy(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right[1] > 100 and right[0] > 0.98


def test_keep_identified_and_empty(spark):
    model = language_id.train(corpus(spark))
    docs = documents(spark, [EN, None, "123", "日本語", DE], extra=("lang_pred",))
    kept = language_id.keep_identified(docs, model, 0.5)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]
    nothing = language_id.train(documents(spark, []))
    assert [r.lang_pred for r in language_id.identify(documents(spark, [EN]), nothing).collect()] == ["und"]
    assert language_id.identify(documents(spark, []), model).count() == 0
