import random
import re

import pytest

from plotweave.llm import decontaminate
from tests.llm.helpers import PROSE, awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, items, width):
    cut = lambda t: WORD.findall((t or "").translate(UPPER))
    out = []
    for t in texts:
        words, hit, found = cut(t), set(), set()
        for item, text in items:
            w = cut(text)
            for i in range(max(1, len(w) - width + 1) if w else 0):
                window = w[i : i + width]
                for j in range(len(words) - len(window) + 1):
                    if words[j : j + len(window)] == window:
                        hit.update(range(j, j + len(window)))
                        found.add(item)
        out.append((len(words), len(hit), sorted(found)))
    return out


TEXTS = [t for t in awkward() if not t or len(t) < 1000] + ["x " + PROSE.replace(" ", ", ") + " y", "mill and the", "the mill and the millers", PROSE + " " + PROSE, "ß ß ß", "Ärger ärger"]
ITEMS = [(3, PROSE), (11, "mill and THE"), (2, ""), (5, None), (7, "ß!ß"), (8, "ß!ß"), (9, "ärger")]


def test_same_as_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for width in (3, 10):
        rows = decontaminate.find_contamination(documents(spark, TEXTS, extra=("spans", "item_ids")), items, width).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.item_ids) for r in rows] == brute(TEXTS, ITEMS, width)
        for r, t in zip(rows, TEXTS, strict=True):
            assert sum(len(WORD.findall(t[s.start : s.end].translate(UPPER))) for s in r.spans) == r.n_hit


def test_random_texts_against_brute_force():
    """Few words, so blocks repeat within items, overlap and run into the ends of texts."""
    rng = random.Random(5)
    for width in (1, 2, 3, 4, 7, 10):
        for letters in ("ab", "abcdefgh"):
            items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 3 * width)))) for i in range(12)]
            texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(40)]
            texts += [f"{rng.choice(texts)} {t} {rng.choice(texts)}" for _, t in items]
            known = decontaminate.Items([(i, t.encode()) for i, t in items], width)
            found = [known.scan(t.encode()) for t in texts]
            assert [(n, 0 if m is None else int(m.sum()), sorted(s)) for n, s, m in found] == brute(texts, items, width)


def test_many_items_and_item_size(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(3000)]
    known = decontaminate.Items([(i, t.encode()) for i, t in items], 10)
    assert known.digits == 3
    for i, t in items[::100]:
        assert known.scan(("x " + " ".join(t.split()[7:17]) + " y").encode())[1:2] == ({i},) and known.scan(" ".join(t.split()[7:16]).encode())[2] is None
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 10)
    with pytest.raises(ValueError):
        decontaminate.find_contamination(documents(spark, ["a"]), spark.createDataFrame(ITEMS, "item_id long, text string"))


def test_long_texts_and_string_ids(spark):
    long = (PROSE + " ") * 3000
    items = spark.createDataFrame([("x", PROSE), ("y", "mill and the")], "item_id string, text string")
    rows = decontaminate.find_contamination(documents(spark, [long, "other"]), items).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in rows] == [(len(long.split()), len(long.split()), ["x", "y"]), (1, 0, [])]
    assert [(s.start, s.end) for s in rows[0].spans] == [(0, len(long) - 1)]


def test_drop_keeps_columns_and_clean_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, TEXTS, extra=("n_hit",))
    kept = decontaminate.drop_contaminated(docs, items, 10)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, n, _) in enumerate(brute(TEXTS, ITEMS, 10)) if not n]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none, 10).count() == len(TEXTS)
    assert decontaminate.find_contamination(documents(spark, []), items).count() == 0
