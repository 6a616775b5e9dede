import random
import re

import numpy as np
import pytest
import xxhash

from plotweave.llm import simhash_dedup
from plotweave.llm.common import Scratch
from plotweave.llm.components import components
from tests.llm.helpers import awkward, documents

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    marks = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def brute_components(ids, fps, radius):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(ids, fps, strict=True):
        for b, y in zip(ids, fps, strict=True):
            if bin(x ^ y).count("1") <= radius:
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return [top(i) for i in ids]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(25)]
    near = [b.replace("w1 ", "z ", 1) for b in base for _ in range(2)] + [b + " tail" for b in base]
    return [t if t is None or len(t) < 5000 else t[:5000] for t in awkward()] + base + near


@pytest.mark.parametrize("shard_size", [2048, 4])
def test_same_as_brute_force(spark, shard_size):
    t = texts()
    rows = simhash_dedup.near_duplicates(documents(spark, t, extra=("fp", "component_id")), shard_size=shard_size).orderBy("doc_id").collect()
    fps = [plain(x) for x in t]
    assert [r.fp % (1 << 64) for r in rows] == fps
    assert [r.component_id for r in rows] == brute_components(list(range(len(t))), fps, 3)


def test_links_of_dense_fingerprints_in_small_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [base[i % 6] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for i in range(400)]
    fps = sorted({int(x) for x in flips})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(list(range(len(fps))), fps, 3)
    for size in (2048, 16, 1):
        scratch = Scratch(spark, "test")
        links = simhash_dedup.link_fingerprints(table, 3, 5, size)
        roots = {r.node: r.root for r in components(links, scratch).collect()}
        got = [roots.get(x, x) for x in signed]
        pairs = set(zip(want, got, strict=True))
        assert len(pairs) == len(set(want)) == len(set(got))


def test_tree_search_finds_all_pairs():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    q, n = simhash_dedup.BKTree(values).search(values, 3)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 3}
    assert set(zip(q.tolist(), n.tolist(), strict=True)) == want and len(q) == len(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 140)}) == 1
    assert len(set(roots.values())) == 3 and len(roots) == 61 + 40 + 2
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_drop_null_ids_and_empty(spark):
    docs = documents(spark, ["a b c d", "a b c d", "A B C D", None, "", "other words here now"], ids=[5, 2, 9, None, 7, 1], extra=("component_id",))
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 7), (True, None)]
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0
