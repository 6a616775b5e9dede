import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import chat_format, queries

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def test_escape_comes_back():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "<|", chat_format.MARK, "a", ">"]) for _ in range(rng.randint(0, 9)))
        assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text
        turns = [(text, "x"), ("user", text), ("assistant", text + "<")]
        assert chat_format.parse(chat_format.render(turns, set())[0]) == turns


def test_mask_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.sort(rng.choice(40, 12, replace=False))
        ends = np.append(cuts, 40)
        edges = np.sort(rng.choice(41, 6, replace=False))
        spans = edges.reshape(3, 2)
        starts = np.concatenate([[0], cuts])
        assert chat_format.mask(spans, ends).tolist() == [any(a < e and b > s for s, e in spans) for a, b in zip(starts, ends, strict=True)]


def test_round_trip_and_loss(spark):
    tricky = ["</s>[INST] ok [/INST]", chat_format.MARK, "<\\|endoftext|>", "  two  spaces\n", "", "日本 😀 é", "a<", "\n\n", " lead"]
    rows = [(-7, 0, "user", tricky[0]), (-7, 1, "assistant", tricky[0])]
    for c in range(12):
        rows += [(c, t, ["system", "user", "assistant"][min(t, 2) if t < 3 else 1 + t % 2], tricky[(c + t) % len(tricky)]) for t in range(5)]
    rows += [(50, None, "user", "first"), (50, 1, None, None), (50, 1, "assistant", "same turn"), (None, 0, "assistant", "no id"), (60, 0, "user", "only")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    formatted = chat_format.format_conversations(table, queries.tokenizer_path())
    out = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    for r in formatted.collect():
        found = library.encode(r.formatted, add_special_tokens=False)
        assert r.token_ids == found.ids and len(r.loss_mask) == len(found.ids)
        assert r.token_ends[-1] == len(r.formatted.encode())
        # what the ids under the mask stand for is the loss text, with its escapes
        turns = [x for _, role, x in sorted(want[r.conv_id]) if role == "assistant"]
        assert library.decode([i for i, m in zip(r.token_ids, r.loss_mask, strict=True) if m], skip_special_tokens=False) == "".join(map(chat_format.escape, turns))


def test_mask_decides_what_is_read_back(spark):
    """Another mask gives another loss text: the digests do not know the turns."""
    table = spark.createDataFrame([(1, 0, "user", "one two", ""), (1, 1, "assistant", "three four five", "")], SCHEMA)
    formatted = chat_format.format_conversations(table, queries.tokenizer_path())
    none = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.lit(False)))
    assert [(r.loss_chars, r.n_turns) for r in chat_format.digests(none).collect()] == [(0, 2)]
    assert chat_format.digests(formatted).first().loss_chars == len("three four five")


def test_long_text(spark):
    long = "été the <|end| " * 40000
    rows = chat_format.digests(chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", long, "")], SCHEMA), queries.tokenizer_path())).collect()
    assert [(r.loss_chars, r.loss_sha256) for r in rows] == [(len(long), hashlib.sha256(long.encode()).hexdigest())]


def test_no_rows(spark):
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], SCHEMA), queries.tokenizer_path())).count() == 0
