from collections import Counter

import corpus_pipeline
from plotweave.llm.common import Scratch, read_table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.helpers import awkward, documents
from tests.llm.test_simhash_similar import brute as near

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = read_table(spark, SF, "documents")
    columns, results = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        results.append(Scratch(spark, "test").save(stage(spark, results[-1], SF), f"stage-{n}"))
    rows = [sorted(r.collect(), key=lambda r: r.doc_id) for r in results]
    assert all(r.columns == columns for r in results[:-1])
    # language: whatever has letters stays, since each text of the table is in one language
    assert [r.doc_id for r in rows[1]] == [r.doc_id for r in rows[0] if any(c.isalpha() for c in r.text or "")]
    # near copies: the first of each brute-force component of texts with a similarity of 0.8 or more (rows are by id)
    tops = near([r.text for r in rows[1]])
    assert [r.doc_id for r in rows[2]] == [r.doc_id for i, r in enumerate(rows[1]) if tops[i] == i]
    # benchmark: rows without a hit
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    hits = contaminated([r.text for r in rows[2]], items, 10)
    assert [r.doc_id for r in rows[3]] == [r.doc_id for r, (_, n, _) in zip(rows[2], hits, strict=True) if not n]
    # mixing: labelled toxic text goes, other text stays
    toxic = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    kept = Counter(r.doc_id for r in rows[4])
    clean = [r.doc_id for r in rows[3] if toxic.get(r.doc_id) == 0]
    assert sum(kept[i] > 0 for i in clean) >= 0.95 * len(clean)
    assert set(kept) <= {r.doc_id for r in rows[3]}
    # shards: all rows, counts at most one apart, slots without gaps
    assert Counter(r.doc_id for r in rows[5]) == kept
    sizes = Counter(r.shard for r in rows[5])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows[5] if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 50


def test_awkward_rows_in_every_stage(spark):
    """Nulls, empty and long texts, repeats, null and repeated ids, and columns named like what stages make."""
    texts = [*awkward(), None, "the river ran past the mill " * 20000]
    ids = [*range(len(texts) - 3), None, None, 0]
    extra = ("shard", "slot", "size", "__id", "component_id", "p", "n_tokens", "often", "row", "lang_pred")
    docs = documents(spark, texts, ids=ids, extra=extra)
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "test").save(stage(spark, docs, SF), "stage")
        found = Counter(r.doc_id for r in out.collect())
        assert set(found) <= set(ids), name
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "language":  # what has no letter goes, null texts too, and what is in a script of no learned language
            assert sum(found.values()) == sum(any(c.isascii() and c.isalpha() for c in t or "") for t in texts)
        elif name == "near duplicates":  # empty and null texts are copies of each other; rows without an id stay
            assert found[None] == 2 and found[5] == 0 and found[3] == 1 and found[1] == 0
        elif name in ("decontamination", "sharding"):
            assert sum(found.values()) == len(texts)


def test_empty_table_in_every_stage(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0, name
