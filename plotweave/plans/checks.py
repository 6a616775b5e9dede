"""Consistency checks over the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import checks, render
from plotweave.plans.story import SQL, Story

PAIRS = """
, seen AS (
  SELECT DISTINCT character_id, scene_id, date, location_id
  FROM presence JOIN scenes USING (scene_id) WHERE role = 'N' AND date IS NOT NULL AND location_id IS NOT NULL),
pairs AS (
  SELECT a.character_id, a.date, a.scene_id AS scene_1, b.scene_id AS scene_2, a.location_id AS location_1, b.location_id AS location_2
  FROM seen a JOIN seen b ON a.character_id = b.character_id AND a.date = b.date AND a.location_id <> b.location_id AND a.scene_id < b.scene_id)
"""


def bilocalization_all(spark, sf_dir):
    """E1 over all scenes."""
    s = Story(spark, sf_dir)
    return checks.bilocalization(s.presence(), s.scenes(), role="N")


def bilocalization_scene(spark, sf_dir):
    """E1 with one scene fixed: only that scene's date is looked at."""
    s = Story(spark, sf_dir)
    return checks.bilocalization_of(s.presence(), s.scenes(), 22, role="N")


def bilocalization_issues(spark, sf_dir):
    """P1, D16, J8: the issue rows."""
    s = Story(spark, sf_dir)
    named = checks.with_names(checks.bilocalization(s.presence(), s.scenes(), role="N"), s.characters(), s.scenes(), s.locations())
    return named.select(*render.bilocation_issue(F.col("scene_2")))


def timeline_context(spark, sf_dir):
    """P2, I2, H5: a scene and those related to it, in order of date with nulls last."""
    s = Story(spark, sf_dir)
    scenes = s.scenes()
    related = scenes.where("location_id = 3 AND status = 'P'").select("scene_id", "date")
    return checks.timeline_context(related, scenes.where("scene_id = 100").select("scene_id", "date"))


def profile_diff(spark, sf_dir):
    """C14, D11: fields of a profile that an edit changes, after trimming and with blank as null."""
    s = Story(spark, sf_dir)
    before = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("arc"), F.col("c_name").alias("background"))
    key = F.col("id")
    after = before.select("id", F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.concat(F.lit(" "), F.col("arc"), F.lit(" "))).otherwise("changed").alias("arc"), F.when(key % 2 == 0, F.col("background")).alias("background"))
    return checks.profile_changes(before, after, "id", ["arc", "background"])


PLANS = {
    "bilocalization_all": (bilocalization_all, SQL + PAIRS + "SELECT * FROM pairs"),
    "bilocalization_scene": (bilocalization_scene, SQL + PAIRS + "SELECT * FROM pairs WHERE scene_1 = 22 OR scene_2 = 22"),
    "bilocalization_issues": (bilocalization_issues, SQL + PAIRS + """
SELECT 'biloc-' || character_id || '-' || scene_1 || '-' || scene_2 AS id, 'bilocalization' AS type, 'error' AS severity, scene_2 AS scene_id, character_id AS entity_id,
  c.name || ' takes part in two scenes of one date: "' || s1.title || '" at ' || l1.name || ', "' || s2.title || '" at ' || l2.name || '.' AS description,
  'One of the dates may be wrong, or the role: whoever is only mentioned need not be there.' AS suggestion
FROM pairs JOIN characters c ON c.id = character_id JOIN scenes s1 ON s1.scene_id = scene_1 JOIN scenes s2 ON s2.scene_id = scene_2
JOIN locations l1 ON l1.id = location_1 JOIN locations l2 ON l2.id = location_2"""),
    "timeline_context": (timeline_context, SQL + """
SELECT scene_id, date, CAST(row_number() OVER (ORDER BY date NULLS LAST, scene_id) AS INTEGER) AS place
FROM (SELECT scene_id, date FROM scenes WHERE location_id = 3 AND status = 'P' UNION SELECT scene_id, date FROM scenes WHERE scene_id = 100)"""),
    "profile_diff": (profile_diff, """
WITH b AS (SELECT c_custkey AS id, c_mktsegment AS arc, c_name AS background FROM customer),
a AS (SELECT id, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN arc ELSE 'changed' END AS arc, CASE WHEN id % 2 = 0 THEN background END AS background FROM b),
d AS (SELECT b.id, 'arc' AS field, b.arc AS before, a.arc AS after FROM b JOIN a USING (id) UNION ALL SELECT b.id, 'background', b.background, a.background FROM b JOIN a USING (id))
SELECT * FROM d WHERE before IS DISTINCT FROM after"""),
}
