import hashlib
import zlib
from collections import Counter

import pytest

from plotweave.llm import sharding
from tests.llm.helpers import awkward, documents


def brute(rows, shards, seed):
    """(id, size, crc, shard, slot) by sorting everything in one place."""
    part = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / (1 << 32)
    by = {}
    for i, text, source in rows:
        raw = (text or "").encode()
        of = "" if source is None else "=" + source
        draw = hashlib.md5(f"{seed}:{'' if i is None else i}:{zlib.crc32(raw)}:{of}".encode()).hexdigest()
        by.setdefault(of, []).append((draw, i, zlib.crc32(raw), len(raw) + 16))
    order = []
    for source, members in by.items():
        for r, (_, i, crc, size) in enumerate(sorted(members)):
            order.append(((r + part(f"{seed}/{source}")) / len(members), source, i, crc, size))
    order.sort()
    n, out, slots = len(order), [], Counter()
    for at, (_, _, i, crc, size) in enumerate(order):
        shard = at * shards // n
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("least", [256, 3])
def test_same_as_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(sharding, "LEAST_BUCKET", least)
    texts = awkward() * 20
    sources = [None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 11}" for i in range(len(texts))]
    docs = documents(spark, texts, sources=sources, extra=("shard", "slot", "size"))
    got = sorted(tuple(r) for r in sharding.interleave(docs, 7, seed=5).collect())
    assert got == brute(list(zip(range(len(texts)), texts, sources, strict=True)), 7, 5)


def test_laws_hold(spark):
    texts = ["t"] * 1000
    sources = ["hot" if i < 700 else f"s{i % 5}" for i in range(1000)]
    rows = sharding.interleave(documents(spark, texts, sources=sources), 9, carry=("source",)).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(9)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for source, n in Counter(sources).items():
        each = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(each[s] - n * sizes[s] / 1000) <= 2 for s in sizes)


def test_repeated_null_and_no_rows(spark):
    docs = documents(spark, ["a", "a", None, "b"], ids=[1, 1, None, None])
    assert sorted((r.shard, r.slot) for r in sharding.interleave(docs, 3).collect()) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert sharding.interleave(documents(spark, []), 3).count() == 0
    assert len(sharding.interleave(documents(spark, ["x"]), 40).collect()) == 1


def test_carried_columns_whose_names_clash(spark):
    docs = documents(spark, ["x", "y"], extra=("shard", "slot", "size", "shard_in"))
    out = sharding.interleave(docs, 2, carry=("text", "shard", "slot", "size", "shard_in"))
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "shard_in_in", "slot_in", "size_in", "shard_in"]
    assert {r.shard_in_in for r in out.collect()} == {"x"} and sorted(r.text for r in out.collect()) == ["x", "y"]
