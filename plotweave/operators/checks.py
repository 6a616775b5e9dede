"""Deterministic consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import text as T


def bilocalization(presence: DataFrame, scenes: DataFrame, role: str = "participant") -> DataFrame:
    """Pairs of scenes on one date at different locations that share a character in ``role``.

    ``presence``: character_id, scene_id, role. ``scenes``: scene_id, date, location_id. Each pair comes once, with the
    smaller scene id first. Null dates and locations match nothing. The self-join is on (character, date), so both
    sides share one partitioning and no scene pair is formed beyond those that one character has on one date.
    """
    seen = (
        presence.where(F.col("role") == role)
        .select("character_id", "scene_id")
        .join(scenes.where(F.col("date").isNotNull() & F.col("location_id").isNotNull()).select("scene_id", "date", "location_id"), "scene_id")
        .distinct()
    )
    one = seen.select("character_id", "date", F.col("scene_id").alias("scene_1"), F.col("location_id").alias("location_1"))
    two = seen.select("character_id", "date", F.col("scene_id").alias("scene_2"), F.col("location_id").alias("location_2"))
    return one.join(two, ["character_id", "date"]).where((F.col("location_1") != F.col("location_2")) & (F.col("scene_1") < F.col("scene_2")))


def bilocalization_of(presence: DataFrame, scenes: DataFrame, scene_id, role: str = "participant") -> DataFrame:
    """The pairs of ``bilocalization`` in which one scene takes part: other scenes are cut to its date and people first."""
    own = scenes.where(F.col("scene_id") == F.lit(scene_id))
    people = presence.where((F.col("scene_id") == F.lit(scene_id)) & (F.col("role") == role)).select("character_id").distinct()
    same_day = scenes.join(own.select("date").distinct(), "date", "left_semi")
    pairs = bilocalization(presence.join(people, "character_id", "left_semi"), same_day, role)
    return pairs.where((F.col("scene_1") == F.lit(scene_id)) | (F.col("scene_2") == F.lit(scene_id)))


def with_names(pairs: DataFrame, characters: DataFrame, scenes: DataFrame, locations: DataFrame) -> DataFrame:
    """Pairs with the names and titles that issue texts need."""
    out = pairs.join(characters.select(F.col("id").alias("character_id"), F.col("name").alias("character_name")), "character_id")
    for n in ("1", "2"):
        out = out.join(scenes.select(F.col("scene_id").alias(f"scene_{n}"), F.col("title").alias(f"title_{n}")), f"scene_{n}")
        out = out.join(locations.select(F.col("id").alias(f"location_{n}"), F.col("name").alias(f"location_name_{n}")), f"location_{n}")
    return out


def timeline_context(related: DataFrame, current: DataFrame) -> DataFrame:
    """Related scenes and the current one, once each, with their place in order of date (nulls last, then by id).

    The related scenes come from a search for a few, so numbering them in one task is bounded by its size.
    """
    rows = related.unionByName(current).distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("date").asc_nulls_last(), "scene_id")))


def profile_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``id, field, before, after`` for the fields that differ once trimmed, blank counting as null."""
    clean = lambda c: T.null_if_blank(T.strip(c))
    old, new = (t.select(key, F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[clean(F.col(f)) for f in fields])).alias(n)) for t, n in ((before, "o"), (after, "n")))
    return old.join(new, key).select(key, "n", F.explode("o").alias("field", "before")).select(key, "field", "before", F.try_element_at("n", F.col("field")).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def context_payload(scenes: DataFrame) -> DataFrame:
    """One JSON text of the scenes of a context, in order of their place."""
    return scenes.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("place", "scene_id", "date"))), lambda s: F.struct(s["scene_id"].alias("scene_id"), s["date"].alias("date")))).alias("payload"))


def edit_evidence(fragments: DataFrame, summaries: DataFrame, raw: DataFrame) -> DataFrame:
    """Fragments with the summary and text of their scene, empty where there is none."""
    out = fragments.join(summaries.select("scene_id", "summary"), "scene_id", "left").join(raw.select("scene_id", "raw_text"), "scene_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("summary", "raw_text")})
