"""Temporal checks over events and statuses, with partial dates.

A date may be a year, a month or a day (``1943``, ``1943-05``, ``1943-05-17``) and stands for the range of days that it can be.
Findings are ``certain`` if every choice of days violates the order, and possible if only some do. Each check first
reduces one side to a row per character or thing, so its joins make no more rows than the larger side has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_range(date: Column) -> Column:
    """struct<low date, high date> of a partial date; null if it is none."""
    text = F.trim(date.cast("string"))
    year, month, day = r"^\d{4}$", r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"
    low = F.when(text.rlike(year), F.concat(text, F.lit("-01-01"))).when(text.rlike(month), F.concat(text, F.lit("-01"))).when(text.rlike(day), text)
    low = F.try_to_timestamp(low, F.lit("yyyy-MM-dd")).cast("date")
    high = F.when(text.rlike(year), F.make_date(F.year(low), F.lit(12), F.lit(31))).when(text.rlike(month), F.last_day(low)).otherwise(low)
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def _dated(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """``rows`` (scene_id, ...) with the range of their scene's date; those without one go."""
    dates = scenes.select("scene_id", date_range(F.col("date")).alias("span")).where("span IS NOT NULL")
    return rows.join(dates, "scene_id")


def _first(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row whose date can be earliest, and the earliest day by which one of them is over."""
    earliest = F.min_by(F.struct("scene_id", "span"), F.struct("span.low", "span.high", "scene_id"))
    return rows.groupBy(key).agg(earliest.alias("f"), F.min("span.high").alias("by"), F.min("span.low").alias("low")).select(key, F.col("f.scene_id").alias("first_scene"), "low", "by")


def present_after_death(presence: DataFrame, statuses: DataFrame, scenes: DataFrame, role: str = "participant", dead: str = "dead") -> DataFrame:
    """``character_id, death_scene, scene_id, certain``: presences in ``role`` after the character's first death.

    ``statuses``: character_id, scene_id, status. Certain: the scene begins after a day by which a death is over.
    """
    deaths = _first(_dated(statuses.where(F.col("status") == dead).select("character_id", "scene_id"), scenes), "character_id")
    seen = _dated(presence.where(F.col("role") == role).select("character_id", "scene_id").distinct(), scenes)
    late = seen.join(deaths, "character_id").where(F.col("span.high") > F.col("low")).where(F.col("scene_id") != F.col("first_scene"))
    return late.select("character_id", F.col("first_scene").alias("death_scene"), "scene_id", (F.col("span.low") > F.col("by")).alias("certain"))


def used_before_known(uses: DataFrame, known: DataFrame, scenes: DataFrame, thing: str = "thing_id") -> DataFrame:
    """``character_id, thing, scene_id, first_scene, certain``: facts learned before they are revealed, objects used before
    they are introduced.

    ``uses``: character_id, the thing, scene_id; ``known``: the thing, scene_id. A thing that is never made known is no
    finding. Certain: the use is over before the first day on which the thing can have been known.
    """
    first = _first(_dated(known.select(thing, "scene_id").distinct(), scenes), thing)
    used = _dated(uses.select("character_id", thing, "scene_id").distinct(), scenes)
    early = used.join(first, thing).where((F.col("span.low") < F.col("by")) & (F.col("scene_id") != F.col("first_scene")))
    return early.select("character_id", thing, "scene_id", "first_scene", (F.col("span.high") < F.col("low")).alias("certain"))


def first_encounters(presence: DataFrame, scenes: DataFrame, role: str = "participant") -> DataFrame:
    """``id_a, id_b, scene_id, date``: the earliest scene (by its first possible day, then id) in which two characters both are.

    Rows are made per scene, two by two of its cast, as for relations.
    """
    seen = _dated(presence.where(F.col("role") == role).select("character_id", "scene_id").distinct(), scenes)
    one, two = seen.select("scene_id", F.col("character_id").alias("id_a"), "span"), seen.select("scene_id", F.col("character_id").alias("id_b"))
    pairs = one.join(two, "scene_id").where("id_a < id_b")
    first = pairs.groupBy("id_a", "id_b").agg(F.min(F.struct("span.low", "scene_id")).alias("f"))
    return first.select("id_a", "id_b", "f.scene_id", F.col("f.low").alias("date"))


def status_as_of(presence: DataFrame, statuses: DataFrame, scenes: DataFrame) -> DataFrame:
    """``character_id, scene_id, status, since``: the last status that a character surely has when a scene begins, null if none.

    An as-of join: a character's changes come as one sorted list (as long as its changes), and each presence picks the last
    one that is over by the scene's first day; of changes over on one day the one in the larger scene id counts.
    """
    changes = _dated(statuses.select("character_id", "scene_id", "status"), scenes).groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct("span.high", "scene_id", "status"))).alias("changes"))
    seen = _dated(presence.select("character_id", "scene_id").distinct(), scenes).join(changes, "character_id", "left")
    last = F.try_element_at(F.filter("changes", lambda c: c["high"] <= F.col("span.low")), F.lit(-1))
    return seen.select("character_id", "scene_id", last["status"].alias("status"), last["scene_id"].alias("since"))
