"""Incremental import: scene files, progress events and clarifications."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import text as T
from plotweave.functions.lineage import cut
from plotweave.operators import checks, extract, merge, render, resolve, search, segment
from plotweave.sources import schemas
from plotweave.sources.store import Busy, Store

# States of an import and the seconds that a clarification waits.
FINAL = ("done", "error")
WAIT_SECONDS = 30

EVENTS = schemas.EVENTS

# What the analysis of a scene gives.
ANALYSED = ("title", "summary", "era", "approximate_date", "characters", "location", "mood", "beats", "relations")


def fold_progress(events: DataFrame) -> DataFrame:
    """Per import the last value of each field that is not null, counts by kind, and whether it ended.

    Works on a table and on a stream alike. Order is that of ``seq``.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("import_id").agg(
        *[last(c) for c in ("status", "file", "scene_id", "processed", "total", "message")],
        F.count_if(F.col("event") == "scene_loaded").alias("scenes_loaded"),
        F.count_if(F.col("event") == "issue_found").alias("issues_found"),
        F.count_if(F.col("event") == "scene_error").alias("scenes_failed"),
        F.coalesce(F.bool_or(F.col("event").isin(*FINAL)), F.lit(False)).alias("ended"),
    )


def clarifications(requests_and_answers: DataFrame, wait_seconds: int = WAIT_SECONDS) -> DataFrame:
    """``clarification_id, outcome``: the first answer to a request, or ``timeout`` once it has waited so long.

    Rows: clarification_id, kind (request, answer), answer. An answer before its request counts; later ones do not.
    State of a clarification goes once it is decided and its time has passed.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        asked, answer, done = state.get if state.exists else (False, None, False)
        if state.hasTimedOut:
            if asked and not done:
                yield pd.DataFrame({"clarification_id": [key[0]], "outcome": ["timeout"]})
            state.remove()
            return
        for frame in frames:
            asked = asked or bool((frame["kind"] == "request").any())
            given = frame.loc[frame["kind"] == "answer", "answer"].dropna()
            answer = answer if answer is not None or given.empty else given.iloc[0]
        decided = asked and answer is not None and not done
        state.update((asked, answer, done or decided))
        state.setTimeoutDuration(wait_seconds * 1000)
        if decided:
            yield pd.DataFrame({"clarification_id": [key[0]], "outcome": [answer]})

    return requests_and_answers.groupBy("clarification_id").applyInPandasWithState(step, "clarification_id STRING, outcome STRING", "asked BOOLEAN, answer STRING, done BOOLEAN", "append", "ProcessingTimeTimeout")


def _event(kind: str, rows: DataFrame, import_id: str, phase: int, **fields) -> DataFrame:
    """Progress events of one kind, one for each row; ``fields`` are columns of the event."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    names = [f.split(" ") for f in schemas.EVENTS.split(", ")]
    seq = F.lit(phase).cast("long") * 10**15 + F.monotonically_increasing_id() % 10**15
    own = {"import_id": F.lit(import_id), "seq": seq, "event": F.lit(kind)}
    return rows.select(*[(own | given).get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _issues(of: str, resolved: DataFrame) -> DataFrame:
    """The issues of ambiguous mentions (scene_id, name, entity_id, ... of ``resolve_in_order``, with ``answer``)."""
    unclear, apart = F.col("status") == "ambiguous", F.col("told_apart")
    linked = unclear & F.col("answer").eqNullSafe("link")
    score = F.format_string("%.2f", F.coalesce("score", F.lit(0.0)))
    text = F.when(apart, F.concat(F.lit(f'{of} "'), "name", F.lit('" is another one than "'), F.coalesce("like_name", F.lit("")), F.lit('", as answered; it has an entry of its own.')))
    text = text.otherwise(F.concat(F.lit(f'{of} "'), "name", F.lit('" may be "'), "entity_name", F.lit('" (score '), score, F.when(linked, "); confirmed.").otherwise("); linked for now.")))
    return resolved.where(unclear | apart).select(
        F.concat(F.lit("dup-"), "scene_id", F.lit("-"), T.slugify(F.col("name"))).alias("id"), F.lit("duplicate_suspect").alias("type"), F.when(apart, "info").otherwise("warning").alias("severity"), "scene_id", "entity_id",
        text.alias("description"), F.when(unclear & ~linked, F.concat(F.lit('Is "'), "name", F.lit('" really "'), "entity_name", F.lit('"?'))).alias("suggestion"), linked.alias("resolved"),
    )


def _clashes(store: Store, dates: DataFrame) -> DataFrame:
    """Issues of people in two places on one of the dates."""
    scenes = store.read("scenes").select(F.col("id").alias("scene_id"), "date", "location_id", "title")
    clash = checks.bilocalization(store.read("presence"), scenes.join(dates, "date", "left_semi"))
    return checks.with_names(clash, store.read("characters"), scenes, store.read("locations")).select(*render.bilocation_issue(F.col("scene_2"))).withColumn("resolved", F.lit(False))


def import_batch(
    store: Store, files: DataFrame, extractor: extract.Extractor = extract.by_rules, max_tokens: int = segment.MAX_TOKENS, answers: DataFrame | None = None, import_id: str = "import", profiler: extract.Extractor | None = None
) -> dict[str, int]:
    """Load scene files (filename, stem, text) into the store; loading a file again replaces its scenes.

    Set-based: segmentation, extraction, resolution in the order of the scenes (a new name is known to later scenes), key
    upserts, and the check over the dates that the batch touches. Of tables by scene only the touched buckets are
    rewritten; all tables become visible together, and a second import meanwhile is refused (``store.Busy``).

    ``answers``: name, answer (link, new) to ambiguous names; without an answer a name is linked and an open warning left.
    ``profiler`` makes profile fields from a person's new scenes, which replace or extend the stored fields (``extract.PROFILE_RULES``). Units whose
    extraction fails are left out and counted; of files with one stem the one whose name comes first counts, the others
    are counted as ``skipped``. Progress goes to ``store.events()``.
    """
    with store.lock():
        try:
            with store.transaction():
                return _load(store, files, extractor, max_tokens, answers, import_id, profiler)
        except Exception as e:
            one = store.spark.range(1)
            store.append_events(_event("error", one, import_id, 99, status="error", message=f"{type(e).__name__}: {str(e)[:200]}"))
            raise


def _load(store: Store, files: DataFrame, extractor: extract.Extractor, max_tokens: int, answers: DataFrame | None, import_id: str, profiler: extract.Extractor | None) -> dict[str, int]:
    spark = store.spark

    def tell(kind: str, rows: DataFrame, phase: int, **fields) -> None:
        store.append_events(_event(kind, rows, import_id, phase, **fields))

    one = spark.range(1)
    answers = spark.createDataFrame([], "name STRING, answer STRING") if answers is None else answers.select("name", "answer").dropDuplicates(["name"])
    tell("status_change", one, 1, status="segmenting")
    every = files.count()
    files = cut(files.groupBy("stem").agg(F.min_by(F.struct("filename", "text"), "filename").alias("f")).select("f.filename", "stem", "f.text"))
    buckets = sorted(r.b for r in files.select(schemas.bucket(F.col("stem")).alias("b")).distinct().collect())
    units = segment.segment_texts(files, "stem", "text", max_tokens)
    units = units.select(T.scene_id(F.col("id"), F.col("idx"), F.col("total")).alias("unit"), "id", "idx", "total", "chunk").join(files.select(F.col("stem").alias("id"), "filename"), "id")
    units = cut(units)
    tell("file_segmented", units.where("idx = 0"), 2, file=F.col("filename"), total=F.col("total"))
    tell("status_change", one, 3, status="analyzing", total=units.count())
    analyzed = cut(extract.analyze(units, "unit", "chunk", extractor))
    good = cut(analyzed.where("error IS NULL").join(units.select(F.col("unit").alias("id"), F.col("id").alias("stem"), "idx", "chunk", "filename"), "id"))
    tell("scene_error", analyzed.where("error IS NOT NULL"), 4, scene_id=F.col("id"), message=F.col("error"))
    tell("scene_analyzed", good, 4, scene_id=F.col("id"), file=F.col("filename"))
    counts = _settle(store, good, files.select("stem"), buckets, answers, import_id, profiler)
    counts |= {"failed": analyzed.where("error IS NOT NULL").count(), "skipped": every - files.count()}
    tell("done", one, 20, status="done", processed=counts["scenes"], total=counts["scenes"] + counts["failed"])
    return counts


def _settle(store: Store, good: DataFrame, stems: DataFrame, buckets: list[int], answers: DataFrame, import_id: str, profiler: extract.Extractor | None) -> dict[str, int]:
    """Resolve analysed scenes (id, stem, idx, chunk, filename, analysis) of whole files and put them in the place of the files' scenes."""
    one = store.spark.range(1)

    def tell(kind: str, rows: DataFrame, phase: int, **fields) -> None:
        store.append_events(_event(kind, rows, import_id, phase, **fields))

    # who and where, in the order of the scenes
    tell("status_change", one, 5, status="resolving")
    place_in_order = F.struct("stem", "idx", F.lit(0).alias("pos")).alias("at")
    mentions = good.select("id", "stem", "idx", "chunk", F.posexplode("characters").alias("pos", "c")).select(F.col("id").alias("scene_id"), F.struct("stem", "idx", "pos").alias("at"), "chunk", "c.*").where("name IS NOT NULL")
    is_group = F.col("character_type").eqNullSafe("group")
    said = answers.withColumnRenamed("name", "__said")
    with_answer = lambda df: df.join(said, F.col("name") == F.col("__said"), "left").drop("__said")
    people = cut(with_answer(resolve.resolve_in_order(mentions.where(~is_group), store.read("characters"), "at", answers)))
    groups = cut(resolve.resolve_groups(mentions.where(is_group), store.read("groups")))
    located = good.where("location IS NOT NULL").select(F.col("id").alias("scene_id"), place_in_order, "location.name", "location.description")
    places = cut(with_answer(resolve.resolve_in_order(located, store.read("locations"), "at", answers)))
    unclear = people.where("status = 'ambiguous'")
    tell("clarification_needed", unclear.where("answer IS NULL"), 6, scene_id=F.col("scene_id"), entity_id=F.col("entity_id"), message=F.concat_ws(" | ", "name", "entity_name", F.coalesce("context", T.excerpt(F.col("chunk"), F.col("name")))))
    for found in (people, places):
        tell("entity_resolved", found, 7, scene_id=F.col("scene_id"), entity_id=F.col("entity_id"), status=F.col("status"), message=F.col("name"))
    era = good.select(F.col("id").alias("scene_id"), "era")

    def put(table: str, rows: DataFrame, rules: dict[str, str], key: list[str] | None = None) -> None:
        """Upsert, in a table by scene within the touched buckets; of rows with one key the last counts."""
        key = key or schemas.key_of(table)
        present = store.read(table, buckets if table in schemas.BUCKETED else None)
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in present.schema if f.name not in rows.columns]
        whole = rows.select("*", *missing)
        last = merge.last_by_key(whole, key, "at" if "at" in whole.columns else key[0])
        store.write(table, merge.upsert(present, last.select(*present.columns), key, rules), buckets if table in schemas.BUCKETED else None)

    tell("status_change", one, 8, status="loading")
    aliases = F.array_sort(F.collect_set(F.when((F.col("status") == "ambiguous") & F.col("answer").eqNullSafe("link"), F.col("name")))).alias("aliases")
    named = people.join(era, "scene_id").groupBy(F.col("entity_id").alias("id")).agg(F.min("entity_name").alias("name"), F.min("era").alias("era"), aliases)
    put("characters", named, {"aliases": "union"})
    put("groups", groups.join(era, "scene_id").groupBy(F.col("group_id").alias("id")).agg(F.min("name").alias("name"), F.min("era").alias("era")), {})
    put("locations", places.groupBy(F.col("entity_id").alias("id")).agg(F.min("entity_name").alias("name"), F.min("description").alias("description"), aliases), {"aliases": "union", "description": "fill"})

    # the files' earlier scenes go, with all that refers to them
    scenes = cut(good.join(places.select(F.col("scene_id").alias("id"), F.col("entity_id").alias("location_id")), "id", "left").select(
        "id", "filename", "title", "summary", "era", F.coalesce("approximate_date", T.era_to_date(F.col("era"))).alias("date"), F.col("chunk").alias("raw_text"), "location_id"
    ))
    for table, column in schemas.BUCKETED.items():
        present = store.read(table, buckets)
        store.write(table, present.withColumn("stem", schemas.stem_of(F.col(column))).join(stems, "stem", "left_anti"), buckets)
    kept_issues = store.read("issues").withColumn("stem", schemas.stem_of(F.col("scene_id"))).join(stems, "stem", "left_anti")
    store.write("issues", kept_issues)

    overwrite = lambda *c: dict.fromkeys(c, "overwrite")
    put("scenes", scenes, {})
    put("presence", people.select(F.col("entity_id").alias("character_id"), "scene_id", "role", "description", "context", "at"), overwrite("role", "description", "context"))
    put("group_presence", groups.select("group_id", "scene_id", "role", "description", "context", "at"), overwrite("role", "description", "context"))
    put("next_chunks", segment.next_chunks(good, "stem", "idx", "id"), overwrite("to_id"))
    event = F.concat(F.lit("evt-"), F.col("id"))
    put("events", scenes.select(event.alias("id"), "date", "era", "title", F.col("summary").alias("description")), overwrite("date", "era", "title", "description"))
    put("event_scenes", scenes.select(event.alias("event_id"), F.col("id").alias("scene_id")), {})
    put("event_locations", scenes.where("location_id IS NOT NULL").select(event.alias("event_id"), "location_id"), {})
    put("participants", people.select(F.col("entity_id").alias("character_id"), F.concat(F.lit("evt-"), F.col("scene_id")).alias("event_id"), "role", "at"), overwrite("role"))
    cast = people.groupBy(F.col("scene_id").alias("id")).agg(F.sort_array(F.collect_set("entity_id")).alias("characters"))
    documents = scenes.join(cast, "id", "left").select("id", F.col("raw_text").alias("document"), search.embed(F.col("raw_text")).alias("embedding"), "era", "location_id", F.coalesce("characters", F.array().cast("array<string>")).alias("characters"))
    analysis = F.to_json(F.struct(*ANALYSED)).alias("analysis")
    put("analyses", good.select("id", "stem", "idx", analysis), overwrite("analysis"))
    put("vectors", documents, overwrite("document", "embedding", "era", "location_id", "characters"))

    # beats with their people, relations and memberships
    who = cut(people.select("scene_id", T.normalize(F.col("name")).alias("norm"), "entity_id").groupBy("scene_id", "norm").agg(F.min("entity_id").alias("entity_id")))
    beats = cut(good.where("beats IS NOT NULL").select(F.col("id").alias("scene_id"), F.posexplode("beats").alias("pos", "b")).select("scene_id", F.format_string("%s-beat-%d", "scene_id", F.col("pos")).alias("id"), "b.*").where("action IS NOT NULL"))
    put("beats", beats.select("id", "scene_id", "action"), overwrite("action"))
    ends = beats.select("id", "scene_id", F.explode(F.create_map(F.lit("subject"), "subject", F.lit("object"), "object")).alias("kind", "name")).where("name IS NOT NULL").withColumn("norm", T.normalize(F.col("name")))
    put("beat_characters", ends.join(who, ["scene_id", "norm"]).select(F.col("id").alias("beat_id"), F.col("entity_id").alias("character_id"), "kind"), {})
    told = good.where("relations IS NOT NULL").select(F.col("id").alias("scene_id"), F.explode("relations").alias("r")).select("scene_id", "r.*").withColumn("norm", T.normalize(F.col("source"))).join(who, ["scene_id", "norm"])
    targets = cut(resolve.relation_targets(told.join(era, "scene_id"), store.read("characters"), store.read("groups")))
    pairs = targets.where("kind = 'character' AND entity_id <> target_id AND relation_type IS NOT NULL").select(F.col("entity_id").alias("id_a"), F.col("target_id").alias("id_b"), "relation_type", "description", "era", "scene_id")
    pairs = cut(merge.undirected_key(pairs, "id_a", "id_b"))
    fresh = pairs.drop("scene_id").dropDuplicates(["id_a", "id_b", "relation_type"])
    judged = cut(resolve.relation_duplicates(fresh.withColumn("relation", F.col("relation_type")), store.read("relations").withColumn("relation", F.col("relation_type")), ["id_a", "id_b"]))
    put("relations", judged.where("band <> 'duplicate' OR best = relation_type"), {"description": "fill", "era": "fill"})
    stands_for = judged.select("id_a", "id_b", "relation_type", F.when(F.col("band") == "duplicate", F.col("best")).otherwise(F.col("relation_type")).alias("stored"))
    told_by = pairs.join(stands_for, ["id_a", "id_b", "relation_type"]).select("id_a", "id_b", F.col("stored").alias("relation_type"), "scene_id").distinct()
    put("relation_scenes", told_by, {})
    joined = targets.where("kind = 'group'").select(F.col("entity_id").alias("character_id"), F.col("target_id").alias("group_id"), "scene_id").distinct()
    put("members", joined.drop("scene_id"), {})
    put("member_scenes", joined, {})
    tell("scene_loaded", scenes, 9, scene_id=F.col("id"), file=F.col("filename"))

    # issues: of ambiguous names, and people in two places on a date that this batch touches
    tell("check_started", one, 10, status="checking")
    dates = scenes.select("date").where("date IS NOT NULL").distinct()
    twice = _clashes(store, dates)
    found = cut(_issues("Character", people).unionByName(_issues("Location", places)).unionByName(twice).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")))
    put("issues", found, overwrite("resolved", "description"))
    tell("issue_found", found, 11, scene_id=F.col("scene_id"), entity_id=F.col("entity_id"), message=F.col("description"))
    tell("check_complete", one, 12, status="checking")

    if profiler is not None:
        tell("status_change", one, 13, status="profiling")
        touched = people.select("entity_id").distinct()
        profiles = cut(extract.profiles(people, scenes, beats, store.read("characters").join(touched, F.col("id") == F.col("entity_id"), "left_semi"), profiler))
        put("characters", profiles.where("error IS NULL").drop("error"), extract.PROFILE_RULES)
        tell("character_profiled", profiles.where("error IS NULL"), 14, entity_id=F.col("id"))
        tell("profiling_error", profiles.where("error IS NOT NULL"), 14, entity_id=F.col("id"), message=F.col("error"))

    return {"scenes": scenes.count(), "issues": store.read("issues").count()}


def late_answers(store: Store, answers: DataFrame, import_id: str = "answers", profiler: extract.Extractor | None = None) -> dict[str, int]:
    """Apply answers (name, answer: link or new) to names that were linked with an open warning; gives the counts of what changed.

    The files with such a warning are resolved again from their stored analyses, with the answers; no model is asked. ``new``
    gives the name an entity of its own, whose scenes, events and beats are taken from the entity it was linked to; relations,
    memberships and clashes that follow from those files only go with them. ``link`` makes the name an alias. Both close the
    warnings. The store is then what it would be with the answers given before the load, but for names that other
    scenes have brought since: those known by now are known to the files, and what other files have decided stays.
    Answers to names without an open warning, timeouts and other texts change nothing, so applying answers twice is applying them once; files
    that were loaded before analyses were stored keep their warnings;
    of several answers to one name the first in the order of the letters counts. A null name or answer is none.
    """
    given = answers.where("answer IN ('link', 'new') AND name IS NOT NULL").groupBy("name").agg(F.min("answer").alias("answer"))
    with store.lock(), store.transaction():
        given = cut(given)
        waiting = store.read("issues").where("type = 'duplicate_suspect' AND severity = 'warning' AND NOT resolved")
        said = given.withColumn("slug", T.slugify(F.col("name")))
        asked = waiting.join(said, F.col("id") == F.concat(F.lit("dup-"), "scene_id", F.lit("-"), "slug"))
        stems = cut(asked.select(schemas.stem_of(F.col("scene_id")).alias("stem")).distinct())
        # files without stored analyses stay as they are
        buckets = sorted(r.b for r in stems.select(schemas.bucket(F.col("stem")).alias("b")).distinct().collect())
        stems = cut(stems.join(store.read("analyses", buckets), "stem", "left_semi"))
        if stems.isEmpty():
            return {"scenes": 0, "edges_gone": 0, "issues_gone": 0}
        texts = store.read("scenes", buckets).select("id", "filename", F.col("raw_text").alias("chunk"))
        held = store.read("analyses", buckets).join(stems, "stem", "left_semi").join(texts, "id")
        good = cut(held.select("id", "stem", "idx", "chunk", "filename", F.from_json("analysis", schemas.ANALYSIS).alias("a")).select("id", "stem", "idx", "chunk", "filename", "a.*"))
        ours = lambda table: store.read(table, buckets).join(stems, schemas.stem_of(F.col("scene_id")) == F.col("stem"), "left_semi")
        dates = cut(store.read("scenes", buckets).join(good.select("id"), "id", "left_semi").select("date").where("date IS NOT NULL").distinct())
        told = {edges: cut(ours(by).select(*schemas.key_of(edges)).distinct()) for edges, by in schemas.TOLD_BY.items()}
        clashes = cut(_clashes(store, dates).select("id"))
        counts = _settle(store, good, stems, buckets, given, import_id, profiler)
        gone = 0
        for edges, by in schemas.TOLD_BY.items():
            key = schemas.key_of(edges)
            untold = cut(told[edges].join(store.read(by), key, "left_anti"))
            gone += untold.count()
            store.write(edges, merge.delete_where(store.read(edges), untold, key))
        solved = cut(clashes.join(_clashes(store, dates).select("id"), "id", "left_anti"))
        store.write("issues", merge.delete_where(store.read("issues"), solved, ["id"]))
        store.append_events(_event("done", store.spark.range(1), import_id, 20, status="done", processed=counts["scenes"], total=counts["scenes"]))
        return {"scenes": counts["scenes"], "edges_gone": gone, "issues_gone": solved.count()}


def requests(events: DataFrame) -> DataFrame:
    """``clarification_id, kind, answer``: the questions of an event log or stream as rows for ``clarifications``, by name."""
    asked = events.where("event = 'clarification_needed' AND message IS NOT NULL")
    return asked.select(F.element_at(F.split("message", r" \| "), 1).alias("clarification_id"), F.lit("request").alias("kind"), F.lit(None).cast("string").alias("answer"))


def apply_outcomes(store: Store, outcomes: DataFrame, checkpoint: str, available_now: bool = True, patience: float = WAIT_SECONDS):
    """Follow a stream of outcomes (``clarification_id``, a name; ``outcome``) and apply them with ``late_answers``.

    Timeouts leave names linked with an open warning. A batch waits ``patience`` seconds for a running import to end; a
    batch that is repeated after a failure finds nothing open and changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        answers = batch.select(F.col("clarification_id").alias("name"), F.col("outcome").alias("answer"))
        until = time.monotonic() + patience
        while True:
            try:
                late_answers(store, answers)
                return
            except Busy:
                if time.monotonic() > until:
                    raise
                time.sleep(0.5)

    writer = outcomes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def import_stream(store: Store, files: DataFrame, checkpoint: str, extractor: extract.Extractor = extract.by_rules, available_now: bool = True, answers=None, profiler: extract.Extractor | None = None):
    """Load files as they arrive, one micro-batch at a time; a batch that is repeated after a failure changes nothing more.

    The checkpoint belongs to one running import: Spark refuses a second query on it. Imports are named by checkpoint and
    batch, so those of another checkpoint are told apart. ``answers`` is a function without arguments that gives the answers
    (name, answer) there are when a batch begins; ``profiler`` is that of ``import_batch``.
    """
    own = f"{zlib.crc32(checkpoint.encode()):08x}"

    def load(batch: DataFrame, n: int) -> None:
        import_batch(store, batch, extractor, answers=answers() if answers else None, import_id=f"{own}-batch-{n}", profiler=profiler)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
