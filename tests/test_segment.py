import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import segment as S


def paragraphs(n, words):
    return "\n\n".join(" ".join(f"p{i}w{j}" for j in range(words)) for i in range(n))


def one_hot(*cuts):
    """Vectors that are equal within a group and orthogonal across the cuts."""
    return lambda blocks: np.eye(8)[[sum(i > c for c in cuts) for i in range(len(blocks))]]


def test_short_blank_and_single_block_texts_stay():
    assert S.segment("") == [""] and S.segment(" \n ") == [" \n "] and S.segment("one two") == ["one two"]
    big = " ".join(["w"] * 500)
    assert S.segment(big, max_tokens=100) == [big]


def test_cuts_at_breakpoints_and_keeps_all_content():
    text = paragraphs(6, 40)
    chunks = S.segment(text, max_tokens=170, overlap=0.2, embed=one_hot(2))
    assert len(chunks) == 2
    assert chunks[0] == "\n\n".join(text.split("\n\n")[:3])
    words = set(text.split())
    assert words == set(" ".join(chunks).split())
    tail = int(int(170 * 0.2) / 1.35)
    assert chunks[1].split("\n\n")[0].split() == chunks[0].split()[-tail:]


def test_small_groups_merge_and_large_ones_split():
    text = paragraphs(10, 20)
    assert len(S.segment(text, max_tokens=260, overlap=0.2, embed=one_hot(0, 1, 2, 3))) == 2
    chunks = S.segment(text, max_tokens=100, overlap=0.1, embed=one_hot())
    assert len(chunks) == 4 and all(S.tokens(c) <= 100 + 100 * 0.1 + 2 for c in chunks)


def test_breakpoints():
    assert S.breakpoints(["a"], one_hot(), 0.5) == [False]
    assert S.breakpoints(["a", "b", "c"], one_hot(1), 0.5) == [False, True, False]
    assert S.breakpoints(["a", "b"], lambda b: np.zeros((2, 3)), 0.45) == [True, False]


def test_rows(spark):
    docs = spark.createDataFrame([(1, paragraphs(8, 40)), (2, "short"), (3, None), (4, "")], "id LONG, text STRING")
    rows = S.segment_texts(docs, "id", "text", max_tokens=150).orderBy("id", "idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert len(by[1]) > 1 and [r.idx for r in by[1]] == list(range(by[1][0].total))
    assert [[r.chunk for r in by[i]] for i in (2, 3, 4)] == [["short"], [""], [""]]
    assert [r.chunk for r in by[1]] == S.segment(paragraphs(8, 40), 150)


def test_windows(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 1.0])], "doc LONG, pos INT, v ARRAY<DOUBLE>")
    out = S.group_at_breaks(S.adjacent_similarity(rows, "doc", "pos", "v"), "doc", "pos", "similarity").orderBy("doc", "pos").collect()
    assert [r.grp for r in out] == [0, 0, 1, 0] and [r.similarity for r in out] == [pytest.approx(1.0), 0.0, None, None]
    links = S.next_chunks(rows.withColumn("id", F.concat_ws("-", "doc", "pos")), "doc", "pos", "id").collect()
    assert {(r.from_id, r.to_id) for r in links} == {("1-0", "1-1"), ("1-1", "1-2")}
