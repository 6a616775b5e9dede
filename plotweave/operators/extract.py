"""Extraction of scene records from text, behind an interface.

An extractor is a function from a list of texts to a list of records with the fields of ``schemas.ANALYSIS``. The
default follows rules and needs no model; a model client can take its place, and runs per Arrow batch on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.sources import schemas

Extractor = Callable[[list[str]], list[dict]]

_HEADING = re.compile(r"^\s*(?:INT|EXT)\.?\s+([^\n-]+?)\s*(?:-\s*([^\n]*))?$", re.M)
_DATE = re.compile(r"\b(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}|\d{4})\b")
_NAME = re.compile(r"\b[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_FILLER = re.compile(r"^\W*$|^\s*(?:\(?(?:cont(?:inue)?d|more)\)?[.:]?|page \d+|\d+)\s*$", re.I)
_COMMON = {"The", "A", "An", "In", "On", "At", "And", "But", "When", "Then", "He", "She", "They", "It"}


def by_rules(texts: list[str]) -> list[dict]:
    """Headings give the place, years the date, runs of capitalised words the people, sentences with people the beats."""
    out = []
    for text in texts:
        heading, date = _HEADING.search(text), _DATE.search(text)
        body = _HEADING.sub("", text)
        names = dict.fromkeys(n for n in _NAME.findall(body) if n.split()[0] not in _COMMON)
        first = next((line.strip() for line in text.splitlines() if line.strip()), "")
        beats = [{"action": b.strip(), "subject": next((n for n in names if n in b), None), "object": next((n for n in list(names)[::-1] if n in b and n != next((m for m in names if m in b), None)), None)} for b in _SENTENCE.split(body) if any(n in b for n in names)]
        people = [{"name": n, "role": "participant", "description": None, "context": None, "character_type": "individual"} for n in names]
        year = date.group(1)[:4] if date else None
        out.append({"title": first[:80], "summary": first, "era": f"{year[:3]}0s" if year else None, "approximate_date": date.group(1) if date else None, "characters": people, "location": {"name": heading.group(1), "description": heading.group(2)} if heading else None, "mood": None, "beats": beats, "relations": []})
    return out


def analyze(units: DataFrame, id_col: str, text_col: str, extractor: Extractor = by_rules) -> DataFrame:
    """``id`` and the fields of an analysis for each unit; ``error`` is set, and the fields null, where extraction failed."""
    source = units.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = ["title", "summary", "era", "approximate_date", "characters", "location", "mood", "beats", "relations"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, t in zip(frame["id"], frame["text"], strict=True):
                try:
                    record, error = extractor([t])[0], None
                except Exception as e:  # a unit that fails is set aside, the others go on
                    record, error = {}, f"{type(e).__name__}: {e}"
                rows.append({"id": i, **{f: record.get(f) for f in fields}, "error": error})
            yield pd.DataFrame(rows, columns=["id", *fields, "error"])

    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, {schemas.ANALYSIS}, error STRING")


# The fields of a profile that a profiler fills.
PROFILE = ("age", "physical", "background", "arc", "traits")
#: How a new profile changes the stored one: some fields are replaced where it has them, others told further.
PROFILE_RULES = {"age": "patch", "physical": "patch", "background": "extend", "arc": "extend", "traits": "patch"}


def apply_model(df: DataFrame, id_col: str, text_col: str, function: Callable[[str], dict], fields: str) -> DataFrame:
    """``id``, the ``fields`` (a DDL list) of the record that ``function`` makes of each text, and ``error`` where it failed.

    The function may call a model; it runs on the executors, text by text within an Arrow batch.
    """
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = df.sparkSession.createDataFrame([], fields).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, t in zip(frame["id"], frame["text"], strict=True):
                try:
                    record, error = function(t), None
                except Exception as e:  # a text that fails is set aside, the others go on
                    record, error = {}, f"{type(e).__name__}: {e}"
                rows.append({"id": i, **{f: record.get(f) for f in names}, "error": error})
            yield pd.DataFrame(rows, columns=["id", *names, "error"])

    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, {fields}, error STRING")


def drop_filler(text: str) -> dict:
    """Without lines that hold no words, page numbers and marks of continuation."""
    return {"text": "\n".join(x for x in text.splitlines() if not x.strip() or not _FILLER.match(x)).strip()}


def clean(df: DataFrame, id_col: str, text_col: str, cleaner: Callable[[str], dict] = drop_filler) -> DataFrame:
    """``id, text``: cleaned texts; the raw one where cleaning failed or left nothing."""
    cleaned = apply_model(df, id_col, text_col, cleaner, "text STRING")
    raw = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"))
    return raw.join(cleaned, "id", "left").select("id", F.coalesce(F.when((F.col("text") != "") & F.col("error").isNull(), F.col("text")), "raw").alias("text"))


def profile_prompts(people: DataFrame, scenes: DataFrame, beats: DataFrame, known: DataFrame) -> DataFrame:
    """``id, prompt``: for each person the stored profile, then its scenes in order of date and id, then its beats.

    ``people``: entity_id, scene_id, role, description, context; ``beats``: scene_id, action. Parts that are empty are left out.
    """
    seen = people.select("entity_id", "scene_id", "role", "description").distinct().join(scenes.select(F.col("id").alias("scene_id"), "date", "title", "summary"), "scene_id")
    line = F.concat_ws(" - ", F.concat(F.lit("["), "scene_id", F.lit("] "), F.coalesce("title", F.lit(""))), "role", "description", "summary")
    fragments = seen.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "scene_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("fragments"))
    acts = people.select("entity_id", "scene_id").distinct().join(beats.select("scene_id", F.col("id").alias("beat"), "action"), "scene_id")
    acts = acts.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("beat", "action"))), lambda x: x["action"]), "\n").alias("acts"))
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{head}:\n"), c))
    profile = F.concat_ws("\n", *[F.when(F.coalesce(F.col(f), F.lit("")) != "", F.concat(F.lit(f"{f}: "), F.col(f))) for f in PROFILE])
    return known.join(fragments, "id", "left").join(acts, "id", "left").select("id", F.concat_ws("\n\n", F.concat(F.lit("Person: "), "name"), part("Known", profile), part("Scenes", F.col("fragments")), part("Beats", F.col("acts"))).alias("prompt"))


def profiles(people: DataFrame, scenes: DataFrame, beats: DataFrame, known: DataFrame, profiler: Callable[[str], dict]) -> DataFrame:
    """``id``, the fields of a profile, and ``error``: what ``profiler`` makes of each person's prompt."""
    return apply_model(profile_prompts(people, scenes, beats, known), "id", "prompt", profiler, ", ".join(f"{f} STRING" for f in PROFILE))


def judge(answers: DataFrame, id_col: str, text_col: str, scorer: Callable[[str], dict]) -> DataFrame:
    """``id, score`` (0 to 1) that ``scorer`` gives each answer; 0 where it fails."""
    scored = apply_model(answers, id_col, text_col, scorer, "score DOUBLE")
    return scored.select("id", F.when(F.col("score").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).alias("score"))


def found_issues(payloads: DataFrame, id_col: str, text_col: str, checker: Callable[[str], dict]) -> DataFrame:
    """``id, type, severity, description``: the issues that ``checker`` (a model or rules) finds in each payload."""
    found = apply_model(payloads, id_col, text_col, checker, "issues ARRAY<STRUCT<type: STRING, severity: STRING, description: STRING>>")
    return found.where("error IS NULL").select("id", F.explode("issues").alias("i")).select("id", "i.*")
