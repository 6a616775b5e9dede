import hashlib

import pytest
from pyspark.sql import functions as F

from plotweave.llm import common, exact_dedup
from plotweave.llm.common import Scratch
from tests.llm.helpers import awkward, documents

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[(t or "").translate(UPPER)]
        known = [x for x in ids if x is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        out.append((i, best, len(ids), i == best))
    return sorted(out, key=str)


TEXTS = awkward() + ["É", "é", "x"] + ["copy"] * 40 + ["COPY"] * 3 + ["tail"]
IDS = [*range(len(TEXTS) - 2), None, 3]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_same_as_brute_force(spark, monkeypatch, keep, weak):
    """With a weak digest different texts share digests, and only the comparison of bytes keeps them apart."""
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    digest = (lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 2), 2, "0"))) if weak else exact_dedup.sha256
    docs = documents(spark, TEXTS, ids=IDS, extra=("digest", "kept"))
    rows = exact_dedup.find_copies(docs, keep=keep, digest=digest, memtable_rows=9).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str) == brute(list(zip(IDS, TEXTS, strict=True)), keep)
    if not weak:
        assert {bytes(r.digest).hex() for r in rows} == {hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest() for t in TEXTS}


def test_filter_holds_what_was_put_in(spark):
    digests = spark.range(2000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"), "id")
    for column in ("digest", "id"):
        scratch = Scratch(spark, "test")
        held = exact_dedup.Filter(digests.where("id < 100"), column, 100, scratch, "some")
        found = {r.id for r in held.probe(digests, column).where("__maybe").collect()}
        assert set(range(100)) <= found and len(found) < 110
        assert held.probe(digests, column).count() == 2000
        none = exact_dedup.Filter(digests.limit(0), column, 0, scratch, "none")
        assert none.probe(digests, column).where("__maybe").count() == 0
    assert exact_dedup.Filter.fits(1 << 23) and not exact_dedup.Filter.fits(1 << 24)
    assert exact_dedup.Filter(digests, "id", 1 << 20, Scratch(spark, "test"), "large").bits == 1 << 24


@pytest.mark.parametrize("rows", [3, 1 << 14])
def test_without_filters_and_with_hot_groups(spark, monkeypatch, rows):
    """Beyond the size of a filter joins take its place; groups of more than HOT_ROWS rows are dealt to several tasks."""
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 1 if rows > 3 else 1 << 25)
    monkeypatch.setattr(common, "HOT_ROWS", rows)
    monkeypatch.setattr(common, "MOST_HOT", 1000)
    found = exact_dedup.find_copies(documents(spark, TEXTS, ids=IDS), keep="largest").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == brute(list(zip(IDS, TEXTS, strict=True)), "largest")


def test_empty_table(spark):
    assert exact_dedup.find_copies(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.find_copies(documents(spark, []), keep="any")
