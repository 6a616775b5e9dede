import random

import pytest

from plotweave.llm import bpe, queries, token_counts
from tests.llm.helpers import awkward, documents

tokenizers = pytest.importorskip("tokenizers")

PIECES = ["a", "b", "'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "²", "é", "ß", "!", "!!", "<|endoftext|>", "<|", "aaaa", "the", " the", " ", "　", "日本", "😀", "\x1c", "\x85", "don't", "_", "Ⅷ", "é"]


def expected(texts):
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_same_as_the_library(spark):
    rng = random.Random(1)
    texts = awkward() + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, " " * 100]
    rows = token_counts.count_tokens(documents(spark, texts, extra=("n_tokens",)), queries.tokenizer_path()).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == expected(texts)
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_ids_come_back_and_memory_is_bounded(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from plotweave.llm import ragged

    monkeypatch.setattr(bpe, "REMEMBER", 3)
    texts = ["one two three <|endoftext|> four", "", "five one", None]
    encoder = bpe.Encoder(bpe.load(queries.tokenizer_path()), keep_ids=True)
    data, offsets = ragged.utf8(pa.array(texts))
    for _ in range(3):
        n, ids = encoder.encode(data, offsets)
        library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
        assert [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)] == [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]


def test_empty_table_and_repeated_ids(spark):
    assert token_counts.count_tokens(documents(spark, []), queries.tokenizer_path()).count() == 0
    rows = token_counts.count_tokens(documents(spark, ["a", "a", None], ids=[1, 1, None]), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 1), (False, 1), (True, 0)]


def thue_morse(n):
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return word


def colliding():
    """Words that a polynomial hash modulo 2^64 takes for each other, periodic words and random ones over two letters."""
    rng = random.Random(3)
    out = []
    for a, b in ("eq", "th", "xz"):
        out += ["".join((a, b)[x] for x in thue_morse(2048)), "".join((b, a)[x] for x in thue_morse(2048)), (a + b) * 1024, (b + a) * 1024]
    return out + ["".join(rng.choice("eq") for _ in range(1024)) for _ in range(20)]


@pytest.mark.parametrize("remember", [600_000, 5])
def test_words_with_colliding_hashes(monkeypatch, remember):
    import numpy as np
    import pyarrow as pa

    from plotweave.llm import ragged

    monkeypatch.setattr(bpe, "REMEMBER", remember)
    monkeypatch.setattr(bpe, "LONG", 4096)
    texts = colliding()
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for weak in (False, True):
        if weak:  # hashes that say nothing: the code points must decide
            monkeypatch.setattr(ragged, "marks", lambda values, starts, ends: (ends - starts).astype(np.uint64))
        encoder = bpe.Encoder(bpe.load(queries.tokenizer_path()), keep_ids=True)
        for batch in ([" ".join(texts)], texts[::2], texts[1::2], texts):  # in one text, in one batch and across batches
            n, ids = encoder.encode(*ragged.utf8(pa.array(batch)))
            if batch is texts:
                assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == want
            else:
                assert ids.tolist() == [i for x in library.encode_batch(batch, add_special_tokens=False) for i in x.ids]


def test_hashes_tell_thue_morse_words_apart():
    import numpy as np
    import pyarrow as pa

    from plotweave.llm import ragged

    data, offsets = ragged.utf8(pa.array(colliding()))
    _, starts, ends, marks = ragged.words(data, offsets)
    assert len(np.unique(marks)) == len(set(colliding()))
    again = ragged.hashes(data, starts[5:], ends[5:])  # wherever a word lies
    assert (again == marks[5:]).all()
    assert ragged.same(data, starts, ends, np.arange(len(starts))).all() and not ragged.same(data, starts, ends, np.roll(np.arange(len(starts)), 1)).any()


def test_colliding_words_in_the_registered_query(spark, tmp_path):
    texts = colliding()
    documents(spark, texts + awkward()).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_token_counts(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == expected(texts + awkward())


def test_marks_tell_slices_apart_and_long_ones_too(monkeypatch):
    import numpy as np

    from plotweave.llm import ragged

    monkeypatch.setattr(ragged, "PIECE", 50)
    monkeypatch.setattr(ragged, "_wrapping", [])
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 49, 50, 51, 200]))) for _ in range(400)] * 2
    values = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    marks = ragged.marks(values, np.concatenate([[0], ends[:-1]]), ends).tolist()
    assert len(set(zip(words, marks, strict=True))) == len(set(words)) == len(set(marks))


@pytest.mark.parametrize("remember", [600_000, 7])
def test_remembered_short_tokens_and_those_at_the_edge_of_two_words(monkeypatch, remember):
    """Pre-tokens of 1 to 17 bytes, zero bytes at their ends, in blocks that repeat and change, at any fill of the table."""
    import numpy as np
    import pyarrow as pa

    from plotweave.llm import ragged

    monkeypatch.setattr(bpe, "REMEMBER", remember)
    rng = random.Random(9)
    words = ["".join(rng.choice("abé日\u0000") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["a" * n + z for n in range(1, 18) for z in ("", "\u0000", "\u0000\u0000")] + ["é" * 8, "aé" * 5, "日" * 5, "<|endoftext|>x"]
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    encoder = bpe.Encoder(bpe.load(queries.tokenizer_path()), keep_ids=True)
    for _ in range(6):
        texts = [" ".join(rng.sample(words, 400)) for _ in range(3)] + [None, ""]
        n, ids = encoder.encode(*ragged.utf8(pa.array(texts)))
        assert [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)] == [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]
        assert len(encoder.edges) - 1 == encoder.short.n + len(encoder.known) <= remember


def test_places_with_one_slot_for_all(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe.Places, "_slot", lambda self, low, high: np.full(len(low), (1 << self.bits) - 2))
    table, low = bpe.Places(), np.arange(3000, dtype=np.uint64)
    for at in range(0, 3000, 500):
        assert (table.find(low[at:], low[at:] // 2) == -1).all()
        table.add(low[at : at + 500], low[at : at + 500] // 2, np.arange(at, at + 500))
    assert (table.find(low, low // 2) == np.arange(3000)).all() and (table.find(low, low // 2 + np.uint64(1)) == -1).all() and table.bits > 12
