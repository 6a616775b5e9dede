"""Schemas and keys of the story tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns and types of each table.
TABLES = {
    "characters": "id STRING, name STRING, era STRING, aliases ARRAY<STRING>, age STRING, physical STRING, background STRING, arc STRING, traits STRING, status STRING",
    "groups": "id STRING, name STRING, era STRING",
    "locations": "id STRING, name STRING, era STRING, description STRING, address STRING, aliases ARRAY<STRING>",
    "scenes": "id STRING, filename STRING, title STRING, summary STRING, era STRING, date STRING, raw_text STRING, location_id STRING",
    "events": "id STRING, date STRING, era STRING, title STRING, description STRING",
    "issues": "id STRING, type STRING, severity STRING, scene_id STRING, entity_id STRING, description STRING, suggestion STRING, resolved BOOLEAN, created_at TIMESTAMP_NTZ",
    "beats": "id STRING, scene_id STRING, action STRING",
    "presence": "character_id STRING, scene_id STRING, role STRING, description STRING, context STRING",
    "group_presence": "group_id STRING, scene_id STRING, role STRING, description STRING, context STRING",
    "relations": "id_a STRING, id_b STRING, relation_type STRING, description STRING, era STRING",
    "members": "character_id STRING, group_id STRING",
    "event_locations": "event_id STRING, location_id STRING",
    "event_scenes": "event_id STRING, scene_id STRING",
    "participants": "character_id STRING, event_id STRING, role STRING",
    "beat_characters": "beat_id STRING, character_id STRING, kind STRING",
    "next_chunks": "from_id STRING, to_id STRING",
    "relation_scenes": "id_a STRING, id_b STRING, relation_type STRING, scene_id STRING",
    "member_scenes": "character_id STRING, group_id STRING, scene_id STRING",
    "analyses": "id STRING, stem STRING, idx INT, analysis STRING",
    "vectors": "id STRING, document STRING, embedding ARRAY<FLOAT>, era STRING, location_id STRING, characters ARRAY<STRING>",
}
KEYS = {
    "presence": ["character_id", "scene_id"], "group_presence": ["group_id", "scene_id"], "relations": ["id_a", "id_b", "relation_type"], "members": ["character_id", "group_id"],
    "event_locations": ["event_id", "location_id"], "event_scenes": ["event_id", "scene_id"], "participants": ["character_id", "event_id"],
    "beat_characters": ["beat_id", "character_id", "kind"], "next_chunks": ["from_id"],
    "relation_scenes": ["id_a", "id_b", "relation_type", "scene_id"],
    "member_scenes": ["character_id", "group_id", "scene_id"],
}

#: Tables in buckets by the file of their scene: the column that holds an id of it.
BUCKETED = {
    "scenes": "id", "events": "id", "beats": "id", "presence": "scene_id", "group_presence": "scene_id", "event_locations": "event_id", "event_scenes": "event_id",
    "participants": "event_id", "beat_characters": "beat_id", "next_chunks": "from_id", "vectors": "id",
    "relation_scenes": "scene_id", "member_scenes": "scene_id", "analyses": "id",
}
BUCKETS = 16

#: Edges that no scene's key holds, and the tables that say which scenes tell them.
TOLD_BY = {"relations": "relation_scenes", "members": "member_scenes"}

EVENTS = "import_id STRING, seq BIGINT, event STRING, status STRING, file STRING, scene_id STRING, entity_id STRING, processed INT, total INT, message STRING"
ENTITY = "STRUCT<name: STRING, role: STRING, description: STRING, context: STRING, character_type: STRING>"
BEAT = "STRUCT<action: STRING, subject: STRING, object: STRING>"
RELATION = "STRUCT<source: STRING, target: STRING, relation_type: STRING, description: STRING>"
ANALYSIS = f"title STRING, summary STRING, era STRING, approximate_date STRING, characters ARRAY<{ENTITY}>, location STRUCT<name: STRING, description: STRING>, mood STRING, beats ARRAY<{BEAT}>, relations ARRAY<{RELATION}>"
HISTORY = "ts STRING, date STRING, commit STRING, branch STRING, suite STRING, model STRING, passed BIGINT, total BIGINT, duration_s DOUBLE, cases MAP<STRING, BOOLEAN>, case_durations MAP<STRING, DOUBLE>"


def stem_of(scene_id: Column) -> Column:
    """The stem of the file that a scene, event or beat id belongs to."""
    scene = F.regexp_replace(F.regexp_replace(scene_id, "^evt-", ""), "-beat-[0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(scene, "^scene-", ""), "-chunk-[0-9]+$", "")


def bucket(stem: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(stem, F.lit(""))), F.lit(BUCKETS)).cast("int")


def key_of(table: str) -> list[str]:
    return KEYS.get(table, ["id"])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has; empty if the key holds."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def assert_key(df: DataFrame, key: list[str]) -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"rows share the key {key}")
