import shutil

import pytest

from plotweave.sources import schemas
from plotweave.sources.store import Store
from plotweave.streaming import imports


def scene(people, place, date, beats=(), relations=()):
    entity = lambda n, kind: {"name": n, "role": "participant", "description": None, "context": None, "character_type": kind}
    return {
        "title": place, "summary": place, "era": "1910s", "approximate_date": date, "mood": None, "location": {"name": place, "description": None},
        "characters": [entity(n, "group" if n.endswith("Guild") else "individual") for n in people],
        "beats": [{"action": a, "subject": s, "object": o} for a, s, o in beats],
        "relations": [{"source": a, "target": b, "relation_type": kind, "description": None} for a, b, kind in relations],
    }


STORY = {
    "one": scene(["Lena Voss", "Harbour Guild"], "Lighthouse", "1913-05-02", [("waits", "Lena Voss", None)]),
    "two": scene(["Voss", "Karl Anders"], "Archive", "1913-05-02", [("meets", "Karl Anders", "Voss")], [("Karl Anders", "Voss", "fears"), ("Voss", "Harbour Guild", "belongs")]),
    "three": scene(["Lena Voss", "Karl Anders", "Voss"], "Market", "1914", [("sees", "Voss", "Lena Voss")], [("Karl Anders", "Lena Voss", "trusts")]),
    "four": scene(["Mira Okonjo"], "Harbour", "1915"),
}


def told(texts):
    return [STORY[t] for t in texts]


def load(spark, root, answers=None):
    store = Store(spark, "file://" + str(root))
    files = spark.createDataFrame([(f"{n}.txt", str(n), t) for n, t in enumerate(STORY)], "filename STRING, stem STRING, text STRING")
    imports.import_batch(store, files, told, answers=answers)
    return store


@pytest.fixture(scope="module")
def unanswered(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("unanswered") / "store"
    load(spark, root)
    return root


def copy(spark, unanswered, to):
    shutil.copytree(unanswered, to)
    return Store(spark, "file://" + str(to))


def said(spark, *rows):
    return spark.createDataFrame(list(rows), "name STRING, answer STRING")


def contents(store):
    """All tables but the times at which issues were made."""
    out = {}
    for table in schemas.TABLES:
        df = store.read(table)
        out[table] = sorted((str(r) for r in df.drop("created_at").collect()))
    return out


@pytest.mark.parametrize("answer", ["new", "link"])
def test_a_late_answer_ends_where_an_early_one_does(spark, tmp_path, unanswered, answer):
    answers = said(spark, ("Voss", answer))
    early = contents(load(spark, tmp_path / "early", answers))
    store = copy(spark, unanswered, tmp_path / "late")
    before = contents(store)
    assert len(before["issues"]) == 3 and before != early  # two open warnings, and Lena in two places
    counts = imports.late_answers(store, answers)
    after = contents(store)
    for table in schemas.TABLES:
        assert after[table] == early[table], table
        schemas.assert_key(store.read(table), schemas.key_of(table))
    assert counts == ({"scenes": 2, "edges_gone": 2, "issues_gone": 1} if answer == "new" else {"scenes": 2, "edges_gone": 0, "issues_gone": 0})
    # once more, timeouts, unknown names and nulls change nothing
    more = said(spark, ("Voss", answer), ("Karl Anders", "new"), ("Voss", "timeout"), (None, "new"), ("Voss", None))
    assert imports.late_answers(store, more)["scenes"] == 0
    assert contents(store) == after


def test_files_without_analyses_stay(spark, tmp_path, unanswered):
    store = copy(spark, unanswered, tmp_path / "old")
    store.write("analyses", store.read("analyses").where("stem NOT IN ('1', '2')"))
    before = contents(store)
    assert imports.late_answers(store, said(spark, ("Voss", "new"))) == {"scenes": 0, "edges_gone": 0, "issues_gone": 0}
    assert contents(store) == before


def test_outcomes_of_clarifications_reach_the_store(spark, tmp_path, unanswered):
    store = copy(spark, unanswered, tmp_path / "store")
    asked = imports.requests(store.events()).distinct()
    assert [tuple(r) for r in asked.collect()] == [("Voss", "request", None)]
    schema = "clarification_id STRING, outcome STRING"
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    for rows, people in (([("Voss", "timeout")], 3), ([("Voss", "new")], 4), ([("Voss", "link")], 4)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = imports.apply_outcomes(store, spark.readStream.schema(schema).parquet(folder), checkpoint)
        query.awaitTermination()
        assert store.read("characters").count() == people
    assert store.read("issues").where("severity = 'warning'").count() == 0
    with store.lock():  # an import is running
        spark.createDataFrame([("Voss", "link")], schema).coalesce(1).write.mode("append").parquet(folder)
        query = imports.apply_outcomes(store, spark.readStream.schema(schema).parquet(folder), checkpoint, patience=1)
        with pytest.raises(Exception, match="an import is running"):
            query.awaitTermination()
