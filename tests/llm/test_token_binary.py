import zlib

import numpy as np
import pytest

from plotweave.llm import queries, token_binary
from plotweave.llm.common import Scratch
from tests.llm.helpers import awkward, documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = token_binary.feistel(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 64 or (out != token_binary.feistel(np.arange(n), n, 6)).any()


def test_round_trip_and_resume(spark):
    texts = awkward()
    docs = documents(spark, texts, extra=("slot",)).repartition(3)
    docs = Scratch(spark, "test").save(docs, "docs")
    path = Scratch(spark, "test").path("shards")
    n = token_binary.materialise(docs, queries.tokenizer_path(), path, length=16, shard_rows=256, key=3)
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 50256]
        for part in range(-(-len(ids) // 16)):
            want[i, part] = ids[16 * part : 16 * part + 16]
    assert n == len(want)
    rows = token_binary.sequences(token_binary.read_blocks(spark, path)).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    assert {(r.id, r.part): (r.length, r.tokens_crc32) for r in rows} == {k: (len(v), zlib.crc32(np.array(v, "<u2").tobytes())) for k, v in want.items()}
    by_slot = {r.slot: (r.id, r.part) for r in rows}
    # every record stands at its fixed place, and a read from a slot gives the rest
    later = token_binary.read_blocks(spark, path, from_slot=300).orderBy("first_slot").collect()
    at = later[0].first_slot
    assert at <= 300 < at + token_binary.BLOCK_ROWS
    for block in later:
        assert block.first_slot == at and len(block.payload) == block.n * 32
        for i in range(block.n):
            ids = np.frombuffer(block.payload, "<u2", 16, i * 32).tolist()
            assert ids == (want[by_slot[at + i]] + [50256] * 16)[:16]
        at += block.n
    assert at == n


def test_registered_query_and_files_in_order(spark, tmp_path, monkeypatch):
    """The query against the library, with words that weak hashes confuse; the stored files in the order of their slots."""
    from tests.llm.test_token_counts import colliding

    texts = colliding() + awkward()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op1_token_binary(spark, str(tmp_path)).collect()
    want = {(i, part): np.array(ids[512 * part : 512 * part + 512], "<u2") for i, t in enumerate(texts) for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 50256]] for part in range(-(-len(ids) // 512))}
    assert {(r.doc_id, r.part): r.tokens_crc32 for r in rows} == {k: zlib.crc32(v.tobytes()) for k, v in want.items()}
    monkeypatch.setattr(token_binary, "PARTITIONS", 2)
    path = f"{tmp_path}/shards"
    n = token_binary.materialise(spark.read.parquet(f"{tmp_path}/documents.parquet"), queries.tokenizer_path(), path, length=8, shard_rows=256, key=2)
    import glob

    import pyarrow.parquet as pq

    firsts = [x for f in sorted(glob.glob(f"{path}/*.parquet")) for x in pq.read_table(f, columns=["first_slot"]).column(0).to_pylist()]
    assert firsts == list(range(0, n, token_binary.BLOCK_ROWS)) and len(glob.glob(f"{path}/*.parquet")) == 2


def test_repeated_ids_and_no_rows(spark):
    path = Scratch(spark, "test").path("shards")
    assert token_binary.materialise(documents(spark, ["a", "a", None], ids=[1, 1, None]), queries.tokenizer_path(), path) == 3
    assert token_binary.sequences(token_binary.read_blocks(spark, path)).count() == 3
    path = Scratch(spark, "test").path("shards")
    assert token_binary.materialise(documents(spark, []), queries.tokenizer_path(), path) == 0
    assert token_binary.read_blocks(spark, path).count() == 0


def test_every_text_is_read_and_encoded_once(spark, tmp_path):
    """A source that says what it gives, and gives other partitions when it is read again."""
    import os

    log, ids = str(tmp_path / "log"), list(range(40))
    os.mkdir(log)

    def noted(batches):
        import random
        import uuid

        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                open(f"{log}/{i}-{uuid.uuid4().hex}", "w").close()
            texts = [(t or "") + " again" * random.SystemRandom().randint(0, 60) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=["doc_id", "text"])

    docs = documents(spark, ["one two"] * len(ids), ids=ids).select("doc_id", "text").repartition(3).mapInArrow(noted, "doc_id long, text string")
    path = Scratch(spark, "test").path("shards")
    n = token_binary.materialise(docs, queries.tokenizer_path(), path, length=8, shard_rows=256, key=3)
    assert sorted(int(f.split("-")[0]) for f in os.listdir(log)) == ids
    rows = token_binary.sequences(token_binary.read_blocks(spark, path)).collect()
    assert sorted(r.slot for r in rows) == list(range(n)) and {r.id for r in rows} == set(ids)


def test_nothing_is_left_between_the_steps_and_long_texts_leave_in_pieces(spark, monkeypatch):
    """Sequences come out of the encoder a few at a time, with their ids and places; the table between is dropped."""
    from plotweave.llm.common import shared_dir

    text = " ".join(f"w{i}" for i in range(3000))
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    ids = [*library.encode(text, add_special_tokens=False).ids, 50256]
    path = Scratch(spark, "test").path("shards")
    monkeypatch.setattr(token_binary, "CHUNK", 64)
    n = token_binary.materialise(documents(spark, ["", text, None], ids=[7, 8, 9]), queries.tokenizer_path(), path, length=16, shard_rows=256, key=3)
    got = {(r.id, r.part): r.tokens_crc32 for r in token_binary.sequences(token_binary.read_blocks(spark, path)).collect()}
    want = {(8, p): zlib.crc32(np.array(ids[16 * p : 16 * p + 16], "<u2").tobytes()) for p in range(-(-len(ids) // 16))}
    end = zlib.crc32(np.array([50256], "<u2").tobytes())
    assert got == {**want, (7, 0): end, (9, 0): end} and n == len(got)
    import glob

    assert not glob.glob(f"{shared_dir(spark).removeprefix('file://')}/plotweave/token-sequences-*/rows")
