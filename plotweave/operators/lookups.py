"""Lookups and traversals over the story tables.

Tables: characters (id, name, aliases, era, ...), locations (id, name, era, ...), groups (id, name), members
(character_id, group_id), scenes (scene_id, title, date, location_id, ...), presence (character_id, scene_id, role),
relations (id_a, id_b, relation_type), events (event_id, date, era, title, description), event_locations, participants.
Ascending orders put nulls last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def name_matches(text: str, name: str = "name", aliases: str | None = "aliases") -> Column:
    """Case-insensitive substring of the name or of any alias."""
    q = F.lower(F.lit(text))
    own = F.contains(F.lower(F.col(name)), q)
    return own if aliases is None else own | F.coalesce(F.exists(aliases, lambda a: F.contains(F.lower(a), q)), F.lit(False))


def collect_sorted(*fields: str) -> Column:
    """Rows of a group as a sorted array of structs; rows whose first field is null are left out."""
    return F.sort_array(F.collect_list(F.when(F.col(fields[0]).isNotNull(), F.struct(*fields))))


def relations_of(relations: DataFrame, characters: DataFrame) -> DataFrame:
    """``id, other_id, other_name, relation_type``: relations seen from both ends; a loop is seen once."""
    forth = relations.select(F.col("id_a").alias("id"), F.col("id_b").alias("other_id"), "relation_type")
    back = relations.where("id_a <> id_b").select(F.col("id_b").alias("id"), F.col("id_a").alias("other_id"), "relation_type")
    return forth.unionByName(back).join(characters.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id").select("id", "other_id", "other_name", "relation_type")


def relation_types(relations: DataFrame, a, b) -> DataFrame:
    """Relation types of one pair, in either order of its ends."""
    return relations.where((F.least("id_a", "id_b") == F.least(F.lit(a), F.lit(b))) & (F.greatest("id_a", "id_b") == F.greatest(F.lit(a), F.lit(b)))).select("relation_type")


def timeline(
    events: DataFrame, event_locations: DataFrame, locations: DataFrame, participants: DataFrame, characters: DataFrame,
    era: str | None = None, date_from: str | None = None, date_to: str | None = None, location: str | None = None,
) -> DataFrame:
    """``event_id, date, era, title, location, characters``: one row per event and location; names in order, joined.

    Dates compare as text, both bounds included. A predicate is built only for a filter that is given, so it reaches the scan.
    """
    if era is not None:
        events = events.where(F.col("era") == era)
    if date_from is not None:
        events = events.where(F.col("date") >= date_from)
    if date_to is not None:
        events = events.where(F.col("date") <= date_to)
    placed = events.join(event_locations, "event_id", "left").join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id", "left")
    if location is not None:
        placed = placed.where(F.contains(F.lower("location"), F.lower(F.lit(location))))
    people = participants.join(characters.select(F.col("id").alias("character_id"), "name"), "character_id").groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("characters"))
    return placed.join(people, "event_id", "left").select("event_id", "date", "era", "title", F.coalesce("location", F.lit("")).alias("location"), F.coalesce("characters", F.lit("")).alias("characters"))


def character_details(wanted_characters: DataFrame, everyone: DataFrame, relations: DataFrame, presence: DataFrame, scenes: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """The wanted characters with ``relations``, ``fragments`` and ``groups`` as sorted arrays, each gathered before it is joined."""
    wanted = wanted_characters.select("id")
    rel = relations_of(relations, everyone).join(wanted, "id", "left_semi").groupBy("id").agg(collect_sorted("relation_type", "other_name").alias("relations"))
    frag = presence.join(wanted, F.col("character_id") == F.col("id"), "left_semi").join(scenes.select("scene_id", "title"), "scene_id")
    frag = frag.groupBy(F.col("character_id").alias("id")).agg(collect_sorted("scene_id", "title", "role").alias("fragments"))
    grp = members.join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id").groupBy(F.col("character_id").alias("id")).agg(F.sort_array(F.collect_list("group_name")).alias("groups"))
    return wanted_characters.join(rel, "id", "left").join(frag, "id", "left").join(grp, "id", "left")


def issues_with_scene(issues: DataFrame, scenes: DataFrame, kind: str | None = None, severity: str | None = None, resolved: bool | None = None) -> DataFrame:
    """Issues with their scene's title, newest first; each filter only if given; a null flag counts as open."""
    if kind is not None:
        issues = issues.where(F.col("type") == kind)
    if severity is not None:
        issues = issues.where(F.col("severity") == severity)
    if resolved is not None:
        issues = issues.where(F.coalesce("resolved", F.lit(False)) == resolved)
    return issues.join(scenes.select("scene_id", "title"), "scene_id", "left").orderBy(F.col("created_at").desc_nulls_first(), "issue_id")


def not_yet_members(candidates: DataFrame, members: DataFrame, group_id) -> DataFrame:
    """Characters that are not members of the group."""
    return candidates.join(members.where(F.col("group_id") == F.lit(group_id)).select(F.col("character_id").alias("id")), "id", "left_anti")


def scene_summaries(scenes: DataFrame, locations: DataFrame, presence: DataFrame, characters: DataFrame, group_presence: DataFrame, groups: DataFrame) -> DataFrame:
    """Every scene's record: its columns, the name of its place, and ``characters`` and ``groups`` as sorted arrays of (name, role)."""

    def cast(edges: DataFrame, nodes: DataFrame, key: str, name: str) -> DataFrame:
        named = edges.join(nodes.select(F.col("id").alias(key), "name"), key)
        return named.groupBy("scene_id").agg(collect_sorted("name", "role").alias(name))

    placed = scenes.join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id", "left")
    out = placed.join(cast(presence, characters, "character_id", "characters"), "scene_id", "left").join(cast(group_presence, groups, "group_id", "groups"), "scene_id", "left")
    none = F.array().cast("array<struct<name:string,role:string>>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("characters", "groups")})


def ids_by_name(nodes: DataFrame, name: str, but=None) -> DataFrame:
    """Ids of the nodes of that name (case ignored), without one id."""
    found = nodes.where(F.lower("name") == F.lower(F.lit(name))).select("id")
    return found if but is None else found.where(F.col("id") != F.lit(but))


def paths_without(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Edges (src, dst, type) neither end of which has the label; ``nodes``: id, label."""
    hidden = nodes.where(F.col("label") == label).select("id")
    out = edges
    for end in ("src", "dst"):
        out = out.join(hidden.select(F.col("id").alias(end)), end, "left_anti")
    return out.select("src", "dst", "type")


def found_or_names(found: DataFrame, known: DataFrame, what: str, asked: str, text: str = "text") -> DataFrame:
    """One row ``text``: the blocks of what was found, or that nothing was, with all names that there are."""
    blocks = found.agg(F.array_join(F.sort_array(F.collect_list(text)), "\n\n").alias("text"), F.count("*").alias("n"))
    names = known.select("name").distinct().agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    missing = F.concat(F.lit(f'No {what} matches "{asked}". There are: '), F.when(F.col("names") == "", "none").otherwise(F.col("names")), F.lit("."))
    return blocks.join(names).select(F.when(F.col("n") > 0, F.col("text")).otherwise(missing).alias("text"))


def outcome(existing: DataFrame, wanted: DataFrame, key: str, must_exist: bool) -> DataFrame:
    """``key, status`` of requests for an entity: 200, or 404 where it must exist and does not, 409 where it must not and does."""
    there = existing.select(F.col(key).alias("__k"), F.lit(True).alias("__there")).distinct()
    held = F.coalesce("__there", F.lit(False))
    return wanted.join(there, F.col(key) == F.col("__k"), "left").select(key, F.when(held, 200 if must_exist else 409).otherwise(404 if must_exist else 201).alias("status"))
