import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import checks, evaluate, extract, lookups, metrics, search, segment
from plotweave.operators import scene_eval as E
from plotweave.sources import files, schemas, seed
from plotweave.sources.store import Busy, Store
from plotweave.streaming import imports

SCENES = {
    "001.txt": "INT. LIGHTHOUSE - 1913-05-02\nAda Brandt climbs the stairs. Jonas Weil waits.",
    "002.TXT": "INT. ARCHIVE - 1913-05-02\nAda Brandt reads a map with Mira Okonjo.",
    "003.md": "EXT. HARBOUR - 1913-06-01\nJonas Weil sails.",
    "skip.pdf": "not a scene",
}


def write(folder, names=None):
    folder.mkdir(exist_ok=True)
    for name in names or SCENES:
        (folder / name).write_text(SCENES[name], encoding="utf-8")


def test_import_is_idempotent_and_finds_the_bilocation(spark, tmp_path):
    write(tmp_path / "in")
    store = Store(spark, "file://" + str(tmp_path / "store"))
    for _ in range(2):
        counts = imports.import_batch(store, files.read_scene_files(spark, str(tmp_path / "in")))
        assert counts == {"scenes": 3, "failed": 0, "issues": 1, "skipped": 0}
        assert {t: store.read(t).count() for t in ("scenes", "presence", "events", "participants", "event_locations", "vectors")} == {"scenes": 3, "presence": 5, "events": 3, "participants": 5, "event_locations": 3, "vectors": 3}
        for table in ("characters", "locations", "scenes", "presence", "issues", "events", "participants", "vectors"):
            schemas.assert_key(store.read(table), schemas.key_of(table))
    issue = store.read("issues").first()
    assert issue.id == "biloc-ada-brandt-scene-001-scene-002" and issue.severity == "error" and issue.resolved is False
    assert {r.id for r in store.read("characters").collect()} == {"ada-brandt", "jonas-weil", "mira-okonjo"}
    hits = search.nearest(store.read("vectors"), segment.hash_embed([SCENES["002.TXT"]])[0].tolist(), 2, search.metadata_filter(era="1910s", characters=["ada-brandt"]))
    assert [r.id for r in hits.collect()] == ["scene-002", "scene-001"]
    assert store.vacuum() > 0
    store.wipe()
    assert store.read("scenes").count() == 0


def test_stream_loads_new_files_once(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    for names, n in ((["001.txt"], 1), (["002.TXT", "003.md"], 3), ([], 3)):
        source.mkdir(exist_ok=True)
        if names:
            write(source, names)
        query = imports.import_stream(store, files.stream_scene_files(spark, str(source)), checkpoint)
        query.awaitTermination()
        assert store.read("scenes").count() == n
    assert store.read("issues").count() == 1


def test_failed_units_are_set_aside(spark):
    def fails(texts):
        if "bad" in texts[0]:
            raise ValueError("no")
        return extract.by_rules(texts)

    units = spark.createDataFrame([("a", "bad"), ("b", "Ada Brandt sings in 1920."), ("c", None)], "id STRING, text STRING")
    rows = {r.id: r for r in extract.analyze(units, "id", "text", fails).collect()}
    assert rows["a"].error == "ValueError: no" and rows["a"].characters is None
    assert [c.name for c in rows["b"].characters] == ["Ada Brandt"] and rows["b"].era == "1920s" and rows["c"].error is None


def test_lookups_on_the_seed(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    seed.load(store)
    people = store.read("characters")
    assert [r.id for r in lookups.in_order(people, "era", "name").collect()] == ["ada-brandt", "jonas-weil", "mira-okonjo", "pavel-orlov"]
    assert [r.id for r in people.where(lookups.name_matches("SURVEYOR")).collect()] == ["ada-brandt"]
    assert {r.id for r in people.where(lookups.name_matches("weil")).collect()} == {"jonas-weil"}
    relations = lookups.relations_of(store.read("relations"), people)
    assert {(r.id, r.other_name) for r in relations.collect()} == {("ada-brandt", "Jonas Weil"), ("jonas-weil", "Ada Brandt")}
    scenes = store.read("scenes").select(F.col("id").alias("scene_id"), "date", "location_id")
    found = checks.bilocalization(store.read("presence"), scenes).collect()
    assert [(r.character_id, r.scene_1, r.scene_2) for r in found] == [("ada-brandt", "scene-10", "scene-2")]
    assert [r.scene_1 for r in checks.bilocalization_of(store.read("presence"), scenes, "scene-2").collect()] == ["scene-10"]
    assert store.read("vectors").count() == 4 and store.read("participants").count() == 3
    assert lookups.not_yet_members(people, store.read("members"), "harbour-guild").count() == 3
    order = checks.timeline_context(scenes.where("scene_id <> 'scene-2'").select("scene_id", "date"), scenes.where("scene_id = 'scene-2'").select("scene_id", "date"))
    assert [r.scene_id for r in order.orderBy("place").collect()] == ["scene-1", "scene-10", "scene-2", "scene-1-chunk-01"]
    payload = json.loads(checks.context_payload(order).first().payload)
    assert [x["scene_id"] for x in payload] == ["scene-1", "scene-10", "scene-2", "scene-1-chunk-01"]
    files.export_json({"characters": people}, "file://" + str(tmp_path / "export"))
    assert spark.read.json("file://" + str(tmp_path / "export/characters")).count() == 4


def test_history_and_server_sent_events(spark, tmp_path):
    path = "file://" + str(tmp_path / "history")
    row = ("2024-01-01", "d", None, None, "s", "m", 1, 2, 0.5, {"a": True}, None)
    files.append_history(spark.createDataFrame([row], schemas.HISTORY), path)
    files.append_history(spark.createDataFrame([("2024-01-02", *row[1:4], "t", *row[5:])], schemas.HISTORY), path)
    (tmp_path / "history" / "part-bad.json").write_text('{"ts": "x"\nnot json\n{"ts": "2023", "suite": "s", "passed": 3}\n')
    assert {r.ts for r in files.read_history(spark, path, "s").collect()} == {"2024-01-01", "2023"}
    assert files.malformed_history(spark, path).count() == 2
    body = "event: a\r\ndata: 1\r\ndata: 2\r\n\r\n: note\n\ndata:last"
    rows = files.parse_sse(spark.createDataFrame([("k", body), ("e", "")], "k STRING, body STRING"), "k", "body").collect()
    assert [(r.k, r.pos, r.event, r.data) for r in rows] == [("k", 1, "a", "1\n2"), ("k", 2, "message", "last")]


def test_progress_fold_same_for_table_and_stream(spark, tmp_path):
    rows = [("i", 1, "status_change", "loading", None, None, None, 0, 3, None), ("i", 2, "scene_loaded", None, "f", "s1", None, 1, None, None), ("i", 3, "scene_error", None, None, None, None, None, None, "bad"), ("j", 1, "error", None, None, None, None, None, None, "x")]
    events = spark.createDataFrame(rows, imports.EVENTS)
    out = {r.import_id: r for r in imports.fold_progress(events).collect()}
    assert (out["i"].status, out["i"].file, out["i"].processed, out["i"].total, out["i"].scenes_loaded, out["i"].scenes_failed, out["i"].ended) == ("loading", "f", 1, 3, 1, 1, False)
    assert out["j"].ended
    events.write.parquet(str(tmp_path / "events"))
    stream = imports.fold_progress(spark.readStream.schema(imports.EVENTS).parquet(str(tmp_path / "events")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, out.values()))


@pytest.mark.filterwarnings("ignore")
def test_clarifications_are_answered_or_time_out(spark, tmp_path):
    schema = "clarification_id STRING, kind STRING, answer STRING"
    rows = [("before", "answer", "link"), ("before", "request", None), ("never", "request", None), ("after", "request", None), ("late", "answer", "new")]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = imports.clarifications(stream, wait_seconds=8)
    query = out.writeStream.outputMode("append").format("memory").queryName("clarified").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 30
        while time.time() < deadline and not spark.table("clarified").collect():
            time.sleep(0.5)
        spark.createDataFrame([("after", "answer", "new"), ("after", "answer", "link")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        deadline = time.time() + 60
        while time.time() < deadline and len(spark.table("clarified").collect()) < 3:
            time.sleep(1)
        assert {tuple(r) for r in spark.table("clarified").collect()} == {("before", "link"), ("after", "new"), ("never", "timeout")}
    finally:
        query.stop()


def test_metrics_and_search(spark):
    row = spark.range(1).select(
        metrics.recall(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("r"),
        metrics.keyword_score(F.lit("L'Été à Paris"), F.array(F.lit("ete"), F.lit("rome"))).alias("k"),
        metrics.mutually_contained(F.lit("ab"), F.lit("xabx")).alias("m"),
        metrics.within(F.lit(3), at_least=2, at_most=3).alias("w"),
    ).first()
    assert (row.r, row.k, row.m, row.w) == (0.5, 0.5, True, True)
    table = spark.createDataFrame([(i, [float(i), 0.0], "e" if i % 2 else "f", ["a"]) for i in range(9)], "id INT, embedding ARRAY<FLOAT>, era STRING, characters ARRAY<STRING>")
    assert [r.id for r in search.nearest(table, [4.2, 0.0], 3).collect()] == [4, 5, 3]
    assert [r.id for r in search.nearest(table, [4.2, 0.0], 2, search.metadata_filter("e", ["a"])).collect()] == [5, 3]
    assert search.nearest(table, [0.0, 0.0], 2, search.metadata_filter("none")).count() == 0
    assert [r.id for r in search.related(table, [4.0, 0.0], 4, k=2).collect()] == [3, 5]


def test_evaluators_over_the_seed(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    seed.load(store)
    cases = [
        ("people", "characters", {}, ("recall", "name", ["Ada Brandt", "Pavel Orlov", "Nobody"]), False),
        ("two places", "locations", {}, ("exactly", 2), True),
        ("few scenes", "scenes", {}, ("at_most", 3), False),
        ("cast", "fragments", {"character_id": "ada-brandt", "role": "participant"}, ("at_least", 3), True),
        ("no ghosts", "characters", {}, ("absent", "name", ["Ghost"]), True),
        ("white tower", "locations", {}, ("keywords", "description", ["WHITE", "tower"]), True),
    ]
    out = {r.case_name: r.passed for r in evaluate.run_cases(store, cases_of(cases)).collect()}
    assert out == {c[0]: c[4] for c in cases}


def cases_of(rows):
    return [evaluate.Case(name, query, parameters, check) for name, query, parameters, check, _ in rows]


def record(people, beats=(), relations=(), place=None, era="1910s"):
    who = lambda name, kind: {"name": name, "role": "participant", "description": None, "context": None, "character_type": kind}
    return {"title": "t", "summary": "s", "era": era, "approximate_date": None, "characters": [who(n, k) for n, k in people], "location": {"name": place, "description": None} if place else None, "mood": None, "beats": list(beats), "relations": list(relations)}


def told(texts):
    beat = lambda a, s, o=None: {"action": a, "subject": s, "object": o}
    relation = lambda a, b, kind: {"source": a, "target": b, "relation_type": kind, "description": None}
    scenes = {
        "one": record([("Lena Voss", None), ("Harbour Guild", "group")], [beat("waits", "Lena Voss")], [relation("Lena Voss", "harbour guild", "belongs"), relation("Lena Voss", "Nobody", "knows")], "Old Lighthouse"),
        "two": record([("Voss", None), ("Karl Anders", None), ("Karl Andres", None)], [beat("meets", "Karl Anders", "Voss")], [relation("Karl Anders", "Voss", "fears")], "Old Lighthouse Tower"),
    }
    if "bad" in texts[0]:
        raise ValueError("no")
    return [scenes[t] for t in texts]


def profiler(prompt):
    return {"background": prompt.splitlines()[0], "traits": None}


def test_import_resolves_asks_and_writes_all_tables(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "filename STRING, stem STRING, text STRING")
    counts = imports.import_batch(store, batch(("1.txt", "1", "one"), ("2.txt", "2", "two"), ("2.md", "2", "two"), ("3.txt", "3", "bad")), told, profiler=profiler)
    assert counts == {"scenes": 2, "failed": 1, "issues": 1, "skipped": 1}
    # Voss is linked for now, the tower is the lighthouse, Andres is Anders of the same batch
    assert {r.id for r in store.read("characters").collect()} == {"lena-voss", "karl-anders"}
    assert {(r.character_id, r.group_id) for r in store.read("members").collect()} == {("lena-voss", "harbour-guild")}
    assert {(r.id_a, r.id_b, r.relation_type) for r in store.read("relations").collect()} == {("karl-anders", "lena-voss", "fears")}
    assert {(r.beat_id, r.character_id, r.kind) for r in store.read("beat_characters").collect()} == {("scene-1-beat-0", "lena-voss", "subject"), ("scene-2-beat-0", "karl-anders", "subject"), ("scene-2-beat-0", "lena-voss", "object")}
    assert {(r.type, r.severity, r.resolved) for r in store.read("issues").collect()} == {("duplicate_suspect", "warning", False)}
    assert {r.id: r.background for r in store.read("characters").collect()} == {"lena-voss": "Person: Lena Voss", "karl-anders": "Person: Karl Anders"}
    kinds = {r.event for r in store.events().collect()}
    assert {"status_change", "file_segmented", "scene_analyzed", "scene_error", "clarification_needed", "entity_resolved", "scene_loaded", "issue_found", "check_started", "check_complete", "character_profiled", "done"} <= kinds
    state = imports.fold_progress(store.events()).first()
    assert (state.status, state.processed, state.total, state.ended) == ("done", 2, 3, True)
    # the second file again, with an answer to the name; the first file's tables stay as they were
    answers = spark.createDataFrame([("Voss", "link")], "name STRING, answer STRING")
    older = lambda prompt: profiler(prompt) | {"age": "31", "traits": "calm"}
    imports.import_batch(store, batch(("2.txt", "2", "two")), told, answers=answers, profiler=older)
    # the same background is not told twice
    assert {(r.age, r.background, r.traits) for r in store.read("characters").where("id = 'karl-anders'").collect()} == {("31", "Person: Karl Anders", "calm")}
    assert {r.id: r.aliases for r in store.read("characters").collect()}["lena-voss"] == ["Voss"]
    assert {r.id for r in store.read("locations").collect()} == {"old-lighthouse"}
    assert store.read("scenes").count() == 2 and store.read("presence").count() == 3
    for table in schemas.TABLES:
        schemas.assert_key(store.read(table), schemas.key_of(table))


def test_store_changes_all_tables_or_none(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    row = spark.createDataFrame([("g", "G", None)], schemas.TABLES["groups"])
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.write("groups", row)
        assert store.read("groups").count() == 1
        raise ZeroDivisionError
    assert store.read("groups").count() == 0
    other = Store(spark, store.root)
    with pytest.raises(Busy), store.transaction():
        store.write("groups", row)
        other.write("groups", row)
    with store.lock(), pytest.raises(Busy):
        imports.import_batch(other, spark.createDataFrame([("1.txt", "1", "one")], "filename STRING, stem STRING, text STRING"), told)
    scenes = spark.createDataFrame([(f"scene-{i}", None, None, None, None, None, None, None) for i in range(40)], schemas.TABLES["scenes"])
    store.write("scenes", scenes)
    store.write("scenes", scenes.where(store.bucket_of("scenes") == 3).limit(0), [3])
    left = store.read("scenes").select(store.bucket_of("scenes").alias("b")).distinct().collect()
    assert 3 not in {r.b for r in left} and len(left) == 15
    assert store.read("scenes", [1, 2]).count() == scenes.where(store.bucket_of("scenes").isin(1, 2)).count()


def test_files_reports_and_messages(spark, tmp_path):
    write(tmp_path / "in")
    assert [r.filename for r in files.read_scene_files(spark, str(tmp_path / "in")).collect()] == ["001.txt", "002.TXT", "003.md"]
    upload = spark.createDataFrame([("a.PDF", "x"), ("b.TXT", "y")], "filename STRING, text STRING")
    assert [r.filename for r in files.accept(upload).collect()] == ["b.TXT"]
    with pytest.raises(files.NoScenes):
        files.accept(upload.limit(0))
    tables = {"a": spark.createDataFrame([(1, None), (2, 'q"\n'), (1, None), (1, None)], "x INT, y STRING"), "b": spark.createDataFrame([("z",)], "y STRING"), "none": spark.createDataFrame([], "y STRING")}
    files.export_document(tables, "file://" + str(tmp_path / "out"))
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert document.pop("exported_at").endswith("Z")
    assert document == {"a": [{"x": 1, "y": None}] * 3 + [{"x": 2, "y": 'q"\n'}], "b": [{"y": "z"}], "none": []}
    report = files.markdown_reports(spark.createDataFrame([("s", "c", True, 0.5, 1.25, None)], "suite STRING, case_name STRING, passed BOOLEAN, score DOUBLE, duration_s DOUBLE, detail STRING")).first().report
    assert report.startswith("# c\n") and "- result: passed" in report and "- score: 0.50" in report
    events = spark.createDataFrame([("i", 1, "done", "done", None, None, None, 2, 2, None)], imports.EVENTS)
    events.write.parquet(str(tmp_path / "e"))
    files.write_sse(spark.readStream.schema(imports.EVENTS).parquet(str(tmp_path / "e")), "file://" + str(tmp_path / "sse"), str(tmp_path / "ck")).awaitTermination()
    body = "".join(p.read_text() for p in (tmp_path / "sse").glob("part-*"))
    assert body.startswith("event: done\ndata: {") and body.endswith("}\n\n")


def test_history_durations_and_lists(spark):
    row = ("t1", "d", None, None, "s", "m", 1, 2, 0.5, {"a": True, "b": False}, {"a": 1.5})
    history = spark.createDataFrame([row, ("t2", *row[1:10], {"a": 0.5, "b": None})], schemas.HISTORY)
    assert [tuple(r)[2:] for r in evaluate.durations(history).collect()] == [("a", 2, 1.0, 1.5)]
    assert {(tuple(r.passed_cases), tuple(r.failed_cases)) for r in evaluate.pass_lists(history).collect()} == {(("a",), ("b",))}


def test_models_behind_functions(spark):
    texts = spark.createDataFrame([("a", "Ada waits.\nCONTINUED:\n- - -\n12\nShe leaves."), ("b", "***"), ("c", None)], "id STRING, text STRING")
    assert {r.id: r.text for r in extract.clean(texts, "id", "text").collect()} == {"a": "Ada waits.\nShe leaves.", "b": "***", "c": None}
    scored = extract.judge(texts, "id", "text", lambda t: {"score": 7.0 if t.startswith("Ada") else 1 / len(t)})
    assert {r.id: r.score for r in scored.collect()} == {"a": 1.0, "b": pytest.approx(1 / 3), "c": 0.0}
    issues = extract.found_issues(texts, "id", "text", lambda t: {"issues": [{"type": "timeline_inconsistency", "severity": "warning", "description": t[:3]}]} if t else {"issues": []})
    assert {(r.id, r.description) for r in issues.collect()} == {("a", "Ada"), ("b", "***")}


def test_scene_and_chat_evaluators(spark):
    people = [("Jakes Milton", "participant", "tall, limping today", "individual"), ("Élias", "mentioned", None, None)]
    table = spark.createDataFrame([(people,)], "c ARRAY<STRUCT<name: STRING, role: STRING, description: STRING, character_type: STRING>>")
    c, lit = F.col("c"), F.lit
    row = table.select(
        E.role_accuracy(lit("jakes milton:Participant, elias:participant,Zoe:x, noise"), c).alias("roles"), E.extraction_recall(lit("Milton, Zoe"), c).alias("names"), E.era_matches(lit(" 1910S"), lit("1910s")).alias("era"),
        E.location_matches(lit("phare"), lit("Le Phâre nord")).alias("place"), E.absent(lit("Zoe, Max"), c).alias("absent"), E.description_contains(lit("jakes"), lit("TALL, old"), c).alias("words"),
        E.type_matches(lit("Jakes Milton"), lit("individual"), c).alias("kind"), E.fleeting(["limping", "tired"], c).alias("fleeting"), E.facts(lit("Été, mill, river"), lit("l'ete at the mill")).alias("facts"),
        E.refuses(lit("Désolé, aucune information ici")).alias("refuses"), E.role_accuracy(lit(None).cast("string"), c).alias("nothing"),
    ).first()
    assert (row.roles.accuracy, row.roles.missing, row.roles.wrong) == (pytest.approx(1 / 3), ["zoe"], ["elias"])
    assert (row.names.recall, row.names.missing) == (0.5, ["zoe"]) and row.era and row.place and row.absent and row.words == 0.5 and row.kind
    assert row.fleeting == ["tall, limping today"] and row.facts.score == pytest.approx(2 / 3) and row.facts.passed and row.facts.missing == ["river"] and row.refuses and row.nothing.accuracy == 1.0


def test_related_by_names_and_many_queries(spark, monkeypatch):
    table = spark.createDataFrame([("a", "Ada Brandt at the lighthouse"), ("b", "Jonas in the harbour"), ("c", "Ada at the lighthouse again")], "id STRING, document STRING")
    table = table.select("id", "document", search.embed(F.col("document")).alias("embedding"))
    assert [r.id for r in search.related_by_names(table, ["Ada"], "lighthouse", "a", k=2).collect()][0] == "c"
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(60)] + [(60, None), (61, [1.0])]
    table = spark.createDataFrame(rows, "id INT, embedding ARRAY<DOUBLE>")
    queries = table.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted((q, i, d, r + 1) for q, v in rows[:60:7] for r, (d, i) in enumerate(sorted((float(np.square(np.subtract(v, w)).sum()), i) for i, w in rows[:60])[:4]))
    for size in (1 << 25, 100):
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in search.nearest_each(table, queries, 4).collect()) == want
