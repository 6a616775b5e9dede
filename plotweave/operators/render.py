"""Text blocks of lookups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line(label: str, value: Column) -> Column:
    """``label: value``, or null (and so left out by ``block``) where the value is null or empty."""
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value.cast("string")))


def block(*lines: Column) -> Column:
    """The lines that are not null, one below the other."""
    return F.concat_ws("\n", *lines)


def character_block(columns: list[str]) -> Column:
    """Name, aliases, era, profile, groups, relations and scenes of a row of ``character_details`` with these columns."""
    relations = F.transform("relations", lambda r: F.concat(F.lit("  "), r["relation_type"], F.lit(" - "), r["other_name"]))
    scenes = F.transform("fragments", lambda s: F.concat(F.lit("  ["), s["scene_id"].cast("string"), F.lit("] "), s["title"], F.lit(" ("), s["role"], F.lit(")")))
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{head}:\n"), F.array_join(items, "\n")))
    joined = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{head}: "), F.array_join(c, ", ")))
    profile = [line(head, F.col(c).cast("string")) for head, c in (("Age", "age"), ("Physical", "physical"), ("Background", "background"), ("Arc", "arc"), ("Traits", "traits"), ("Status", "status")) if c in columns]
    return block(
        line("Name", F.col("name")), *([joined("Aliases", "aliases")] if "aliases" in columns else []), line("Era", F.col("era").cast("string")), *profile,
        joined("Groups", "groups"), part("Relations", relations), part("Scenes", scenes),
    )


def location_block() -> Column:
    return block(line("Name", F.col("name")), line("Era", F.col("era")), line("Description", F.col("description")), line("Address", F.col("address")))


def timeline_line() -> Column:
    """An event of ``timeline``: date, title and place, and below it the people."""
    place = F.when(F.col("location") != "", F.concat(F.lit(" @ "), F.col("location"))).otherwise("")
    return block(F.concat(F.lit("  ["), F.col("date"), F.lit("] "), F.col("title"), place), F.when(F.col("characters") != "", F.concat(F.lit("    Characters: "), F.col("characters"))))


def timeline_text(events: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """One row ``text``: how many events there are, and their lines in order of date; or that the given filters leave none."""
    lines = events.select("date", "event_id", timeline_line().alias("line"))
    one = lines.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "event_id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    given = ", ".join(f"{k}={v}" for k, v in filters.items() if v is not None) or "none"
    return one.select(F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" found\n"), F.col("lines"))).otherwise(f"No events. Filters: {given}.").alias("text"))


def hit_line() -> Column:
    """A search hit: id, distance to three decimals and the document."""
    return F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] (distance "), F.format_string("%.3f", F.col("distance")), F.lit(")\n"), F.col("document"))


def bilocation_issue(scene_of_issue: Column) -> list[Column]:
    """Issue columns of a pair of ``bilocalization`` joined with names and titles."""
    return [
        F.format_string("biloc-%s-%s-%s", F.col("character_id").cast("string"), F.col("scene_1").cast("string"), F.col("scene_2").cast("string")).alias("id"),
        F.lit("bilocalization").alias("type"),
        F.lit("error").alias("severity"),
        scene_of_issue.alias("scene_id"),
        F.col("character_id").alias("entity_id"),
        F.format_string('%s takes part in two scenes of one date: "%s" at %s, "%s" at %s.', "character_name", "title_1", "location_name_1", "title_2", "location_name_2").alias("description"),
        F.lit("One of the dates may be wrong, or the role: whoever is only mentioned need not be there.").alias("suggestion"),
    ]
