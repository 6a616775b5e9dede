"""Temporal checks (family P) and the approximate index (N4) over the analogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotweave.functions.lineage import shared_folder
from plotweave.operators import inverted, temporal
from plotweave.plans.lookups import _story
from plotweave.plans.story import SQL, Story

#: Share of the lists that a query reads: the vectors have few clusters, so it takes many for a recall of 0.9.
READ = 0.6


def _rough(s: Story):
    """Scenes whose dates are known to the day, the month or the year."""
    key, day = F.col("scene_id") % 3, F.date_format("date", "yyyy-MM-dd")
    return s.scenes().select("scene_id", F.when(key == 0, day).when(key == 1, F.substring(day, 1, 7)).otherwise(F.substring(day, 1, 4)).alias("date"))


def _statuses(s: Story):
    line = s.table("lineitem").where("l_linenumber = 6")
    status = F.when((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "A"), "dead").when(F.col("l_quantity") > 25, "ill").otherwise("well")
    return line.select(F.col("l_suppkey").alias("character_id"), F.col("l_orderkey").alias("scene_id"), status.alias("status"))


def _things(s: Story, line: int):
    return s.table("lineitem").where(F.col("l_linenumber") == line).select(F.col("l_suppkey").alias("character_id"), F.col("l_partkey").alias("thing_id"), F.col("l_orderkey").alias("scene_id"))


def approximate_topk_each(spark, sf_dir):
    """N4: the ten nearest by the index, for every row whose id is divisible by 20."""
    table = Story(spark, sf_dir).table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = table.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = inverted.InvertedFile.build(table, f"{shared_folder(spark)}/plotweave/inverted-{uuid.uuid4().hex}")
    return index.nearest_each(queries, 10, max(1, round(READ * len(index.centres))))


ROUGH = SQL + """
, rough AS (
  SELECT scene_id, CASE scene_id % 3 WHEN 0 THEN date WHEN 1 THEN date_trunc('month', date) ELSE date_trunc('year', date) END::DATE AS low,
    CASE scene_id % 3 WHEN 0 THEN date WHEN 1 THEN last_day(date) ELSE date_trunc('year', date) + INTERVAL 1 YEAR - INTERVAL 1 DAY END::DATE AS high FROM scenes),
statuses AS (
  SELECT l_suppkey AS character_id, l_orderkey AS scene_id, CASE WHEN l_quantity > 45 AND l_returnflag = 'A' THEN 'dead' WHEN l_quantity > 25 THEN 'ill' ELSE 'well' END AS status
  FROM lineitem WHERE l_linenumber = 6)
"""

PLANS = {
    "present_after_death": (
        _story(lambda s: temporal.present_after_death(s.presence(), _statuses(s), _rough(s), role="R")),
        ROUGH + """, deaths AS (
  SELECT character_id, arg_min(scene_id, {'a': low, 'b': high, 'c': scene_id}) AS death_scene, min(low) AS low, min(high) AS by_day FROM statuses JOIN rough USING (scene_id) WHERE status = 'dead' GROUP BY character_id)
SELECT DISTINCT p.character_id, death_scene, p.scene_id, r.low > by_day AS certain FROM presence p JOIN rough r USING (scene_id) JOIN deaths d ON d.character_id = p.character_id
WHERE role = 'R' AND r.high > d.low AND p.scene_id <> death_scene""",
    ),
    "used_before_known": (
        _story(lambda s: temporal.used_before_known(_things(s, 2), _things(s, 1).drop("character_id"), _rough(s))),
        ROUGH + """, known AS (
  SELECT l_partkey AS thing_id, arg_min(scene_id, {'a': low, 'b': high, 'c': scene_id}) AS first_scene, min(low) AS low, min(high) AS by_day FROM lineitem JOIN rough ON scene_id = l_orderkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT DISTINCT l_suppkey AS character_id, thing_id, scene_id, first_scene, r.high < k.low AS certain FROM lineitem JOIN rough r ON scene_id = l_orderkey JOIN known k ON thing_id = l_partkey
WHERE l_linenumber = 2 AND r.low < by_day AND scene_id <> first_scene""",
    ),
    "first_encounters": (
        _story(lambda s: temporal.first_encounters(s.presence(), _rough(s), role="N").withColumn("date", F.col("date").cast("string"))),
        ROUGH + """, seen AS (SELECT DISTINCT character_id, scene_id, low FROM presence JOIN rough USING (scene_id) WHERE role = 'N')
SELECT a.character_id AS id_a, b.character_id AS id_b, arg_min(scene_id, {'a': a.low, 'b': scene_id}) AS scene_id, CAST(min(a.low) AS VARCHAR) AS date
FROM seen a JOIN seen b USING (scene_id) WHERE a.character_id < b.character_id GROUP BY a.character_id, b.character_id""",
    ),
    "status_as_of": (
        _story(lambda s: temporal.status_as_of(s.presence(), _statuses(s), _rough(s))),
        ROUGH + """, seen AS (SELECT DISTINCT character_id, scene_id, low FROM presence JOIN rough USING (scene_id)),
changes AS (SELECT character_id, high, scene_id AS since, max(status) AS status FROM statuses JOIN rough USING (scene_id) GROUP BY ALL)
SELECT s.character_id, s.scene_id, arg_max(status, {'a': high, 'b': since}) AS status, arg_max(since, {'a': high, 'b': since}) AS since
FROM seen s LEFT JOIN changes c ON c.character_id = s.character_id AND high <= low GROUP BY s.character_id, s.scene_id""",
    ),
    "approximate_topk_each": (approximate_topk_each, None),
}
