import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from plotweave.llm import simhash_dedup
from tests.llm.helpers import awkward, documents

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return [top(i) for i in range(len(texts))]


def edited():
    """Texts with one to eight words replaced: similarities around 0.8, some linked only through others."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(20):
        base = [rng.choice(words) for _ in range(150)]
        out.append(" ".join(base))
        for n in range(1, 9):
            base = list(base) if i % 2 else out[-n].split()
            for at in rng.sample(range(150), n if i % 2 == 0 else 2):
                base[at] = f"new{n}"
            out.append(" ".join(base))
    return [t if t is None or len(t) < 5000 else t[:5000] for t in awkward()] + out


def test_same_as_brute_force(spark):
    texts = edited()
    rows = simhash_dedup.similar_documents(documents(spark, texts, extra=("fp", "component_id", "key"))).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == brute(texts)


def test_pipeline_drops_copies_of_four_fifths(spark):
    texts = edited()
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i, top in enumerate(brute(texts)) if i == top]


def test_null_ids_and_empty(spark):
    docs = documents(spark, ["a b c d", "a b c d", "A B C D", None, "", "other words here now"], ids=[5, 2, 9, None, 7, 1])
    kept = simhash_dedup.drop_near_duplicates(docs, find=simhash_dedup.similar_documents)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 7), (True, None)]
    assert simhash_dedup.similar_documents(documents(spark, [])).count() == 0


def test_families_of_mutual_near_copies(spark, monkeypatch):
    """Copies of one text that are like each other or just not: tree shards find what the first text does not link."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(140)]
    texts = []
    for n in range(160):
        words = list(base)
        for at in rng.sample(range(140), rng.choice([1, 2, 2, 3])):
            words[at] = f"e{n}x{at}"
        texts.append(" ".join(words))
    for size in (2048, 20):
        rows = simhash_dedup.similar_documents(documents(spark, texts), shard_size=size).orderBy("doc_id").collect()
        assert [r.component_id for r in rows] == brute(texts)


def test_family_links_over_batches():
    """A family that runs over many batches gives the same links, each of a pair that is similar."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    sims = rng.integers(0, 1 << 10, 60, dtype=np.uint64)
    fps = np.arange(60)
    rows = [(0, 0, p, int(fps[i]), int(sims[i]), int(fps[i]), sets[i].tobytes()) for p in (0, 1) for i in range(60)]
    names = ["key", "shard", "probe", "fp", "sim", "root", "shingles"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    found = []
    for size in (7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[x : x + size]], k) for i, k in enumerate(kinds)], names=names) for x in range(0, len(rows), size)]
        links = [(a, b) for out in simhash_dedup.family_links(iter(batches), 20, 0.4) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        jaccard = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y]))
        assert links and all(jaccard(a, b) >= 0.4 for a, b in links) and len(links) < 60
        found.append(links)
    parent = list(range(60))
    for a, b in found[0]:
        x, y = sorted((parent[a], parent[b]))
        parent = [x if p == y else p for p in parent]
    for i in range(60):
        for j in range(60):
            if np.intersect1d(sets[i], sets[j]).size >= 0.4 * np.union1d(sets[i], sets[j]).size:
                assert parent[i] == parent[j]
