"""Upserts and deletes (families K and I) over the analogue tables.

Present characters are the suppliers; the batch holds every second supplier again, with some fields null or blank, and
new ones made from customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import merge as M
from plotweave.plans.lookups import _story
from plotweave.plans.story import SQL, Story

BATCH = SQL + """
, old AS (SELECT id, name, era, CASE WHEN id % 3 <> 0 THEN 'grew up at ' || nation END AS background, coalesce(aliases, []) AS aliases FROM characters),
new AS (
  SELECT c_custkey * 2 AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '1920s' END AS era,
    CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'seen with ' || c_nationkey END AS background, ['S-' || c_custkey * 2, 'C-' || c_custkey] AS aliases FROM customer),
both_ AS (
  SELECT coalesce(o.id, n.id) AS id, o.id IS NOT NULL AS in_old, n.id IS NOT NULL AS in_new, o.name AS oname, n.name AS nname, o.era AS oera, n.era AS nera,
    o.background AS obg, n.background AS nbg, o.aliases AS oal, n.aliases AS nal
  FROM old o FULL JOIN new n ON o.id = n.id)
"""


def _old(s: Story):
    return s.characters().select("id", "name", "era", F.when(F.col("id") % 3 != 0, F.concat(F.lit("grew up at "), F.col("nation").cast("string"))).alias("background"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def _new(s: Story):
    key = F.col("c_custkey")
    return s.table("customer").select(
        (key * 2).alias("id"), F.col("c_name").alias("name"), F.when(key % 3 == 0, "1920s").alias("era"),
        F.when(key % 4 == 0, " ").when(key % 4 == 1, None).otherwise(F.concat(F.lit("seen with "), F.col("c_nationkey").cast("string"))).alias("background"),
        F.array(F.concat(F.lit("S-"), (key * 2).cast("string")), F.concat(F.lit("C-"), key.cast("string"))).alias("aliases"),
    )


def _upsert(*columns: str, **rules: str):
    return _story(lambda s: M.upsert(_old(s).select("id", *columns), _new(s).select("id", *columns), ["id"], rules))


def _cascade(s: Story):
    """All tables that refer to a scene, without those scenes, as one list of keys."""
    tables = {"scenes": s.scenes(), "presence": s.presence(), "issues": s.issues(), "beats": s.beats()}
    left = M.delete_scenes(tables, s.scenes().where("status = 'O'").select(F.col("scene_id").alias("id")), dict.fromkeys(tables, "scene_id"))
    key = {"scenes": ["scene_id"], "presence": ["character_id", "scene_id", "role"], "issues": ["issue_id"], "beats": ["beat_id"]}
    lists = [left[t].select(F.lit(t).alias("name"), F.concat_ws("/", *[F.col(c).cast("string") for c in key[t]]).alias("row_key")) for t in tables]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])


PLANS = {
    "upsert_insert_if_absent": (_upsert("name", "era", name="keep", era="keep"), BATCH + "SELECT id, CASE WHEN in_old THEN oname ELSE nname END AS name, CASE WHEN in_old THEN oera ELSE nera END AS era FROM both_"),
    "upsert_fill_nulls": (_upsert("era", "background", era="fill", background="fill"), BATCH + "SELECT id, coalesce(oera, nera) AS era, coalesce(obg, nbg) AS background FROM both_"),
    "upsert_overwrite": (_upsert("name", "era", name="overwrite", era="overwrite"), BATCH + "SELECT id, CASE WHEN in_new THEN nname ELSE oname END AS name, CASE WHEN in_new THEN nera ELSE oera END AS era FROM both_"),
    "upsert_patch": (
        _story(lambda s: M.upsert(_old(s).select("id", "background"), _new(s).select("id", "background"), ["id"], {"background": "patch"}, blank_is_null=True)),
        BATCH + "SELECT id, CASE WHEN trim(nbg) <> '' THEN nbg ELSE obg END AS background FROM both_",
    ),
    "upsert_append": (
        _story(lambda s: M.upsert(_old(s).select("id", "background"), _new(s).select("id", "background"), ["id"], {"background": "append"}, blank_is_null=True)),
        BATCH + ", v AS (SELECT id, obg, CASE WHEN trim(nbg) <> '' THEN nbg END AS nbg FROM both_) SELECT id, CASE WHEN obg IS NOT NULL AND nbg IS NOT NULL THEN obg || '. ' || nbg ELSE coalesce(nbg, obg) END AS background FROM v",
    ),
    "alias_append": (
        _story(lambda s: M.upsert(_old(s).select("id", "aliases"), _new(s).select("id", "aliases"), ["id"], {"aliases": "union"}).select("id", F.array_join("aliases", "|").alias("aliases"))),
        BATCH + "SELECT id, array_to_string(CASE WHEN NOT in_new THEN oal WHEN NOT in_old THEN nal ELSE list_concat(oal, list_filter(nal, lambda x: NOT list_contains(oal, x))) END, '|') AS aliases FROM both_",
    ),
    "overwrite_present_fields": (
        _story(lambda s: M.overwrite_present(_old(s).select("id", "era", "background"), _new(s).select("id", F.when(F.col("id") % 6 == 0, F.create_map(F.lit("era"), "era")).otherwise(F.create_map(F.lit("background"), "background")).alias("changes")), "id", ["era", "background"])),
        BATCH + "SELECT id, CASE WHEN in_new AND id % 6 = 0 THEN nera ELSE oera END AS era, CASE WHEN in_new AND id % 6 <> 0 THEN nbg ELSE obg END AS background FROM both_ WHERE in_old",
    ),
    "edge_upsert_dedupe": (
        _story(lambda s: M.last_by_key(s.table("lineitem").select(F.col("l_suppkey").alias("character_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("role"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq")), ["character_id", "scene_id"], "seq").select("character_id", "scene_id", "role", "seq")),
        "SELECT l_suppkey AS character_id, l_orderkey AS scene_id, l_returnflag AS role, l_linenumber * 1000000 + l_partkey AS seq FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey DESC, l_returnflag DESC) = 1",
    ),
    "relation_upsert": (
        _story(lambda s: M.upsert(s.relations(), M.undirected_key(s.relations().where("id_a % 2 = 0").select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), F.lit("knows").alias("relation_type")).distinct(), "id_a", "id_b"), ["id_a", "id_b", "relation_type"], {})),
        SQL + "SELECT * FROM relations UNION SELECT id_a, id_b, 'knows' FROM relations WHERE id_a % 2 = 0",
    ),
    "edges_with_endpoints": (
        _story(lambda s: M.with_endpoints(s.participants().withColumn("character_id", F.col("character_id") * 3), ("character_id", s.characters(), "id"), ("event_id", s.events(), "event_id"))),
        SQL + "SELECT event_id, character_id * 3 AS character_id FROM participants WHERE character_id * 3 IN (SELECT id FROM characters)",
    ),
    "delete_by_edge": (
        _story(lambda s: M.delete_where(s.issues().select("issue_id", "scene_id", "type"), s.scenes().where("status = 'F'").select("scene_id"), ["scene_id"])),
        SQL + "SELECT issue_id, scene_id, type FROM issues WHERE scene_id IS NULL OR scene_id NOT IN (SELECT scene_id FROM scenes WHERE status = 'F')",
    ),
    "delete_scenes_cascade": (
        _story(_cascade),
        SQL + """
, gone AS (SELECT scene_id FROM scenes WHERE status = 'O')
SELECT 'presence' AS name, CAST(character_id AS VARCHAR) || '/' || scene_id || '/' || role AS row_key FROM presence WHERE scene_id NOT IN (SELECT scene_id FROM gone)
UNION ALL SELECT 'issues', CAST(issue_id AS VARCHAR) FROM issues WHERE scene_id IS NULL OR scene_id NOT IN (SELECT scene_id FROM gone)
UNION ALL SELECT 'scenes', CAST(scene_id AS VARCHAR) FROM scenes WHERE status <> 'O'
UNION ALL SELECT 'beats', beat_id FROM beats WHERE scene_id NOT IN (SELECT scene_id FROM gone)""",
    ),
    "relations_deleted": (
        _story(lambda s: M.delete_counted(s.relations(), s.relations().where("id_a % 3 = 0").select("id_a", "id_b", "relation_type").unionByName(s.relations().select(F.lit(-1).cast("long").alias("id_a"), "id_b", "relation_type")), ["id_a", "id_b", "relation_type"])),
        SQL + "SELECT id_a, id_b, relation_type, id_a % 3 = 0 AS deleted FROM (SELECT id_a, id_b, relation_type FROM relations WHERE id_a % 3 = 0 UNION SELECT -1, id_b, relation_type FROM relations)",
    ),
    "member_upsert": (
        _story(lambda s: M.upsert(s.members(), M.with_endpoints(s.characters().select(F.col("id").alias("character_id"), (F.col("id") % 9).cast("int").alias("group_id")), ("group_id", s.groups(), "id")), ["character_id", "group_id"], {})),
        SQL + "SELECT character_id, group_id FROM members UNION SELECT id, id % 9 FROM characters WHERE id % 9 IN (SELECT id FROM groups)",
    ),
    "scenes_of_stem_exact": (_story(lambda s: M.scenes_of_stem(s.chunks(), "1").select("id", "idx")), SQL + "SELECT id, idx FROM chunks WHERE id = 'scene-1' OR starts_with(id, 'scene-1-chunk-')"),
    "resolve_issue": (
        _story(lambda s: s.issues().select("issue_id", F.when(F.col("issue_id") % 5 == 0, True).otherwise(F.coalesce("resolved", F.lit(False))).alias("resolved"))),
        SQL + "SELECT issue_id, event_5 OR coalesce(resolved, false) AS resolved FROM (SELECT *, issue_id % 5 = 0 AS event_5 FROM issues)",
    ),
}
