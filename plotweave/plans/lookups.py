"""Scans, filters, traversals, aggregations and orders (families B to H) over the analogue tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotweave.operators import lookups as L
from plotweave.operators import render
from plotweave.operators import search as N
from plotweave.plans.story import SQL, Story
from plotweave.sources import files as S


def _story(f):
    """A plan of a Story as a query of (spark, sf_dir)."""
    return lambda spark, sf_dir: f(Story(spark, sf_dir))


def _details(s: Story):
    return L.character_details(s.characters().where(L.name_matches("s-1")), s.characters(), s.relations(), s.presence(), s.scenes(), s.members(), s.groups())


def _flat_details(s: Story):
    d = _details(s)
    flat = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ", "), F.lit(""))
    return d.select(
        "id", "name", "era",
        flat("relations", lambda r: F.concat(r["relation_type"], F.lit(":"), r["other_name"])).alias("relations"),
        flat("fragments", lambda x: F.concat(x["scene_id"].cast("string"), F.lit(":"), x["role"])).alias("fragments"),
        F.array_join("groups", ", ").alias("groups"),
    )


def _timeline(s: Story, **filters):
    return L.timeline(s.events(), s.event_locations(), s.locations(), s.participants(), s.characters(), **filters)


TIMELINE = SQL + """
, people AS (SELECT event_id, string_agg(name, ', ' ORDER BY name) AS characters FROM participants JOIN characters ON id = character_id GROUP BY event_id),
rows_ AS (
  SELECT e.event_id, e.date, e.era, e.title, coalesce(l.name, '') AS location, coalesce(p.characters, '') AS characters
  FROM timeline_events e LEFT JOIN event_locations x USING (event_id) LEFT JOIN locations l ON l.id = x.location_id LEFT JOIN people p USING (event_id))
"""

DETAILS = SQL + """
, wanted AS (SELECT * FROM characters WHERE contains(lower(name), 's-1') OR list_bool_or(list_transform(aliases, lambda a: contains(lower(a), 's-1')))),
both_ AS (SELECT id_a AS id, id_b AS other, relation_type FROM relations UNION ALL SELECT id_b, id_a, relation_type FROM relations),
rel AS (SELECT b.id, string_agg(relation_type || ':' || c.name, ', ' ORDER BY relation_type, c.name) AS relations FROM both_ b JOIN characters c ON c.id = other GROUP BY b.id),
frag AS (SELECT character_id AS id, string_agg(scene_id || ':' || role, ', ' ORDER BY scene_id, title, role) AS fragments FROM presence JOIN scenes USING (scene_id) GROUP BY character_id),
grp AS (SELECT character_id AS id, string_agg(g.name, ', ' ORDER BY g.name) AS groups FROM members JOIN groups g ON g.id = group_id GROUP BY character_id)
SELECT w.id, w.name, w.era, coalesce(relations, '') AS relations, coalesce(fragments, '') AS fragments, groups
FROM wanted w LEFT JOIN rel USING (id) LEFT JOIN frag USING (id) LEFT JOIN grp USING (id)
"""

def _flat_summaries(s: Story):
    groups = s.table("lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 5).cast("int").alias("group_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_linestatus").alias("role"))
    found = L.scene_summaries(s.scenes(), s.locations(), s.presence(), s.characters(), groups, s.groups())
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["role"])), ", ").alias(c)
    return found.select("scene_id", "title", "date", "status", "location", flat("characters"), flat("groups"))


def _open_paths(s: Story):
    """Characters and places with their scenes, and scenes with issues, as one graph; issues are hidden."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = s.presence().where("role = 'R'").select(node("c", "character_id").alias("src"), node("s", "scene_id").alias("dst"), F.lit("present").alias("type"))
    edges = edges.unionByName(s.scenes().select(node("l", "location_id").alias("src"), node("s", "scene_id").alias("dst"), F.lit("place").alias("type")))
    edges = edges.unionByName(s.issues().where("scene_id IS NOT NULL").select(node("s", "scene_id").alias("src"), node("i", "issue_id").alias("dst"), F.lit("issue").alias("type")))
    nodes = s.issues().select(node("i", "issue_id").alias("id"), F.lit("Issue").alias("label")).unionByName(s.characters().select(node("c", "id").alias("id"), F.lit("Character").alias("label")))
    return L.paths_without(edges, nodes, "Issue")


def _place_text(s: Story, asked: str):
    places = s.locations().withColumns({"description": F.lit(""), "address": F.lit(None).cast("string")})
    return L.found_or_names(places.where(L.name_matches(asked, aliases=None)).select(render.location_block().alias("text")), s.locations(), "location", asked)


DETAILS_TEXT = SQL + """
, wanted AS (SELECT * FROM characters WHERE contains(lower(name), 's-1') OR list_bool_or(list_transform(aliases, lambda a: contains(lower(a), 's-1')))),
both_ AS (SELECT id_a AS id, id_b AS other, relation_type FROM relations UNION ALL SELECT id_b, id_a, relation_type FROM relations),
rel AS (SELECT b.id, string_agg('  ' || relation_type || ' - ' || c.name, chr(10) ORDER BY relation_type, c.name) AS t FROM both_ b JOIN characters c ON c.id = other GROUP BY b.id),
frag AS (SELECT character_id AS id, string_agg('  [' || scene_id || '] ' || title || ' (' || role || ')', chr(10) ORDER BY scene_id, title, role) AS t FROM presence JOIN scenes USING (scene_id) GROUP BY character_id),
grp AS (SELECT character_id AS id, string_agg(g.name, ', ' ORDER BY g.name) AS t FROM members JOIN groups g ON g.id = group_id GROUP BY character_id)
SELECT w.id, concat_ws(chr(10), 'Name: ' || w.name, 'Aliases: ' || array_to_string(w.aliases, ', '), 'Era: ' || w.era, 'Groups: ' || grp.t, 'Relations:' || chr(10) || rel.t, 'Scenes:' || chr(10) || frag.t) AS text
FROM wanted w LEFT JOIN rel USING (id) LEFT JOIN frag USING (id) LEFT JOIN grp USING (id)
"""

PLANS = {
    # B, H: scans and orders
    "character_list": (_story(lambda s: L.in_order(s.characters().select("id", "name", "era"), "era", "name")), SQL + "SELECT id, name, era FROM characters"),
    "character_by_id": (_story(lambda s: s.characters().where("id = 7").select("id", "name", "era", "nation").limit(1)), SQL + "SELECT id, name, era, nation FROM characters WHERE id = 7"),
    "group_list": (_story(lambda s: L.in_order(s.groups(), "name")), SQL + "SELECT * FROM groups"),
    "location_list": (_story(lambda s: L.in_order(s.locations(), "era", "name")), SQL + "SELECT * FROM locations"),
    "scene_list": (_story(lambda s: L.in_order(s.scenes(), "date", "scene_id")), SQL + "SELECT * FROM scenes"),
    "participation_edges": (_story(lambda s: s.participants().join(s.characters().select(F.col("id").alias("character_id")), "character_id")), SQL + "SELECT character_id, event_id FROM participants JOIN characters ON id = character_id"),
    "scenes_by_id_list": (_story(lambda s: s.scenes().where(F.col("scene_id").isin(1, 5, 99, 10**9)).select("scene_id", "title")), SQL + "SELECT scene_id, title FROM scenes WHERE scene_id IN (1, 5, 99, 1000000000)"),
    "label_counts": (
        _story(lambda s: s.characters().agg(F.count("*").alias("n")).withColumn("label", F.lit("Character")).unionByName(s.scenes().agg(F.count("*").alias("n")).withColumn("label", F.lit("Scene"))).unionByName(s.locations().agg(F.count("*").alias("n")).withColumn("label", F.lit("Location")))),
        SQL + "SELECT 'Character' AS label, count(*) AS n FROM characters UNION ALL SELECT 'Scene', count(*) FROM scenes UNION ALL SELECT 'Location', count(*) FROM locations",
    ),
    # C: filters
    "find_character_ci": (_story(lambda s: s.characters().where(L.name_matches("3TH TRADER")).select("id", "name")), SQL + "SELECT id, name FROM characters WHERE contains(lower(name), '3th trader') OR list_bool_or(list_transform(aliases, lambda a: contains(lower(a), '3th trader')))"),
    "find_location_ci": (_story(lambda s: s.locations().where(L.name_matches("nation_1", aliases=None))), SQL + "SELECT * FROM locations WHERE contains(lower(name), 'nation_1')"),
    "scenes_by_prefix": (_story(lambda s: s.chunks().where(F.col("id").startswith("scene-1")).select("id", "role")), SQL + "SELECT id, role FROM chunks WHERE starts_with(id, 'scene-1')"),
    "scenes_by_any_prefix": (_story(lambda s: s.chunks().where(F.exists(F.array(F.lit("2"), F.lit("31")), lambda p: F.startswith(F.col("id"), F.concat(F.lit("scene-"), p)))).select("id")), SQL + "SELECT id FROM chunks WHERE starts_with(id, 'scene-2') OR starts_with(id, 'scene-31')"),
    "events_not_of_types": (_story(lambda s: s.events().where(~F.col("era").isin("click", "view"))), SQL + "SELECT * FROM timeline_events WHERE era NOT IN ('click', 'view')"),
    # E: traversals
    "relations_undirected": (
        _story(lambda s: L.relations_of(s.relations(), s.characters())),
        SQL + "SELECT r.id, other_id, name AS other_name, relation_type FROM (SELECT id_a AS id, id_b AS other_id, relation_type FROM relations UNION ALL SELECT id_b, id_a, relation_type FROM relations) r JOIN characters c ON c.id = other_id",
    ),
    "relation_types_for_pair": (_story(lambda s: L.relation_types(s.relations(), 9, 3)), SQL + "SELECT relation_type FROM relations WHERE id_a = 3 AND id_b = 9"),
    "character_fragments": (_story(lambda s: s.presence().where("character_id = 5").join(s.scenes(), "scene_id").select("scene_id", "title", "role", "date")), SQL + "SELECT scene_id, title, role, date FROM presence JOIN scenes USING (scene_id) WHERE character_id = 5"),
    "timeline_range": (_story(lambda s: _timeline(s, era="click", date_from="2024-01-03", date_to="2024-01-09")), TIMELINE + "SELECT * FROM rows_ WHERE era = 'click' AND date BETWEEN '2024-01-03' AND '2024-01-09'"),
    "timeline_location_filter": (_story(lambda s: _timeline(s, location="NATION_2")), TIMELINE + "SELECT * FROM rows_ WHERE contains(lower(location), 'nation_2')"),
    "timeline_all": (_story(_timeline), TIMELINE + "SELECT * FROM rows_"),
    "timeline_text": (
        _story(lambda s: _timeline(s, era="signup").select("event_id", render.timeline_line().alias("line"))),
        TIMELINE + "SELECT event_id, '  [' || date || '] ' || title || CASE WHEN location <> '' THEN ' @ ' || location ELSE '' END || CASE WHEN characters <> '' THEN chr(10) || '    Characters: ' || characters ELSE '' END AS line FROM rows_ WHERE era = 'signup'",
    ),
    "character_details": (_story(_flat_details), DETAILS),
    "character_profile_text": (
        _story(lambda s: (d := _details(s)).select("id", render.character_block(d.columns).alias("text"))),
        DETAILS_TEXT,
    ),
    "location_text": (
        _story(lambda s: s.locations().select("id", "name", "era", F.lit("").alias("description"), F.lit(None).cast("string").alias("address")).select("id", render.location_block().alias("text"))),
        SQL + "SELECT id, 'Name: ' || name || chr(10) || 'Era: ' || era AS text FROM locations",
    ),
    "scene_summaries": (
        _story(_flat_summaries),
        SQL + """
, gp AS (SELECT l_orderkey AS scene_id, l_suppkey % 5 AS group_id, l_linestatus AS role FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT scene_id, string_agg(name || ':' || role, ', ' ORDER BY name, role) AS characters FROM presence JOIN characters ON id = character_id GROUP BY scene_id),
g AS (SELECT scene_id, string_agg(name || ':' || role, ', ' ORDER BY name, role) AS groups FROM gp JOIN groups ON id = group_id GROUP BY scene_id)
SELECT scene_id, title, date, status, l.name AS location, coalesce(characters, '') AS characters, coalesce(groups, '') AS groups
FROM scenes LEFT JOIN locations l ON l.id = location_id LEFT JOIN c USING (scene_id) LEFT JOIN g USING (scene_id)""",
    ),
    "hits_with_summaries": (
        _story(lambda s: N.with_summaries(N.nearest(s.table("embeddings").select(F.col("vec_id").alias("id"), "embedding"), [0.1] * 64, 5), s.scenes().select("scene_id", "title", "date")).select("scene_id", "title", "date", F.round("distance", 6).alias("distance"))),
        SQL + ", d AS (SELECT vec_id, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - CAST(0.1 AS DOUBLE)) * (x - CAST(0.1 AS DOUBLE)))) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 5) SELECT scene_id, title, date, round(distance, 6) AS distance FROM d JOIN scenes ON scene_id = vec_id",
    ),
    "paths_without_issues": (
        _story(_open_paths),
        SQL + "SELECT 'c' || character_id AS src, 's' || scene_id AS dst, 'present' AS type FROM presence WHERE role = 'R' UNION ALL SELECT 'l' || location_id, 's' || scene_id, 'place' FROM scenes",
    ),
    "id_by_name": (_story(lambda s: L.ids_by_name(s.characters(), "supplier#000000007").unionByName(L.ids_by_name(s.characters(), "SUPPLIER#000000008", but=8))), SQL + "SELECT id FROM characters WHERE lower(name) = 'supplier#000000007'"),
    "location_or_names": (
        _story(lambda s: _place_text(s, "nation_7").unionByName(_place_text(s, "atlantis"))),
        SQL + "SELECT 'Name: ' || name || chr(10) || 'Era: ' || era AS text FROM locations WHERE contains(lower(name), 'nation_7') UNION ALL SELECT 'No location matches \"atlantis\". There are: ' || string_agg(name, ', ' ORDER BY name) || '.' FROM (SELECT DISTINCT name FROM locations ORDER BY name LIMIT 50)",
    ),
    "timeline_found": (
        _story(lambda s: render.timeline_text(_timeline(s, era="signup", date_from="2024-01-05", date_to="2024-01-06"), {"era": "signup"}).unionByName(render.timeline_text(_timeline(s, era="none"), {"era": "none", "location": None}))),
        TIMELINE + ", t AS (SELECT date, event_id, '  [' || date || '] ' || title || CASE WHEN location <> '' THEN ' @ ' || location ELSE '' END || CASE WHEN characters <> '' THEN chr(10) || '    Characters: ' || characters ELSE '' END AS line FROM rows_ WHERE era = 'signup' AND date BETWEEN '2024-01-05' AND '2024-01-06') SELECT CASE WHEN count(*) > 0 THEN count(*) || ' found' || chr(10) || string_agg(line, chr(10) ORDER BY date, event_id, line) ELSE 'No events. Filters: era=signup.' END AS text FROM t UNION ALL SELECT 'No events. Filters: era=none.'",
    ),
    "request_outcomes": (
        _story(lambda s: L.outcome(s.characters(), s.table("customer").select(F.col("c_custkey").alias("id")), "id", True).withColumn("kind", F.lit("get")).unionByName(L.outcome(s.characters(), s.table("customer").select(F.col("c_custkey").alias("id")), "id", False).withColumn("kind", F.lit("post")))),
        SQL + "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT id FROM characters) THEN 200 ELSE 404 END AS status, 'get' AS kind FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey IN (SELECT id FROM characters) THEN 409 ELSE 201 END, 'post' FROM customer",
    ),
    "issues_filtered": (
        _story(lambda s: L.issues_with_scene(s.issues(), s.scenes(), kind="missing_info", resolved=False)),
        SQL + "SELECT i.*, title FROM issues i LEFT JOIN scenes USING (scene_id) WHERE type = 'missing_info' AND NOT coalesce(resolved, false)",
    ),
    "issues_all": (_story(lambda s: L.issues_with_scene(s.issues(), s.scenes())), SQL + "SELECT i.*, title FROM issues i LEFT JOIN scenes USING (scene_id)"),
    "group_detail": (_story(lambda s: s.groups().join(s.members(), F.col("id") == F.col("group_id")).join(s.characters().select(F.col("id").alias("character_id"), F.col("name").alias("member")), "character_id").select("id", "name", "member")), SQL + "SELECT g.id, g.name, c.name AS member FROM groups g JOIN members ON g.id = group_id JOIN characters c ON c.id = character_id"),
    "location_detail": (_story(lambda s: s.locations().where("id = 4").join(s.scenes(), F.col("id") == F.col("location_id")).select("name", "scene_id", "title")), SQL + "SELECT name, scene_id, title FROM locations JOIN scenes ON id = location_id WHERE id = 4"),
    "beats_expanded": (
        _story(lambda s: s.beats().join(s.scenes().select("scene_id", "date"), "scene_id").join(s.characters().select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id", "left").join(s.characters().select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id", "left").select("beat_id", "action", "date", "subject", "object")),
        SQL + "SELECT beat_id, action, date, a.name AS subject, b.name AS object FROM beats JOIN scenes USING (scene_id) LEFT JOIN characters a ON a.id = subject_id LEFT JOIN characters b ON b.id = object_id",
    ),
    "beats_of_character": (
        _story(lambda s: s.beats().where("subject_id = 7 OR object_id = 7").select("beat_id", "action")),
        SQL + "SELECT beat_id, action FROM beats WHERE subject_id = 7 OR object_id = 7",
    ),
    "members_candidates": (_story(lambda s: L.not_yet_members(s.characters().select("id", "name"), s.members(), 2)), SQL + "SELECT id, name FROM characters WHERE id NOT IN (SELECT character_id FROM members WHERE group_id = 2)"),
    "character_groups": (_story(lambda s: s.members().join(s.groups(), F.col("group_id") == F.col("id")).select("character_id", "name")), SQL + "SELECT character_id, name FROM members JOIN groups ON id = group_id"),
    # F: aggregates
    "issues_by_type": (_story(lambda s: s.issues().groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")), SQL + "SELECT type, count(*) AS n FROM issues GROUP BY type"),
    "era_facet": (_story(lambda s: s.characters().where("era IS NOT NULL").select("era").distinct()), SQL + "SELECT DISTINCT era FROM characters WHERE era IS NOT NULL"),
    "chunk_count": (_story(lambda s: s.chunks().where(F.col("id").startswith("scene-1")).agg(F.count("*").alias("n"))), SQL + "SELECT count(*) AS n FROM chunks WHERE starts_with(id, 'scene-1')"),
    "dashboard_counts": (
        _story(lambda s: s.issues().agg(F.count_if(~F.coalesce("resolved", F.lit(False))).alias("open_issues")).join(s.characters().agg(F.count("*").alias("characters"))).join(s.scenes().agg(F.count("*").alias("scenes"))).join(s.events().agg(F.count("*").alias("events")))),
        SQL + "SELECT (SELECT count(*) FROM issues WHERE NOT coalesce(resolved, false)) AS open_issues, (SELECT count(*) FROM characters) AS characters, (SELECT count(*) FROM scenes) AS scenes, (SELECT count(*) FROM timeline_events) AS events",
    ),
    "role_fragment_count": (_story(lambda s: s.presence().groupBy("character_id").agg(F.count_if(F.col("role") == "R").alias("n"), F.count("*").alias("total"))), SQL + "SELECT character_id, count(*) FILTER (role = 'R') AS n, count(*) AS total FROM presence GROUP BY character_id"),
    "location_names_joined": (_story(lambda s: s.locations().groupBy("era").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))), SQL + "SELECT era, string_agg(name, ', ' ORDER BY name) AS names FROM locations GROUP BY era"),
    # G, H: neighbours and tops
    "first_events": (_story(lambda s: s.events().orderBy("date", "event_id").limit(5)), SQL + "SELECT * FROM timeline_events ORDER BY date, event_id LIMIT 5"),
    "latest_scene_per_location": (
        _story(lambda s: s.scenes().withColumn("n", F.row_number().over(Window.partitionBy("location_id").orderBy(F.desc("date"), "scene_id"))).where("n = 1").drop("n")),
        SQL + "SELECT * FROM scenes QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY date DESC, scene_id) = 1",
    ),
    "event_json_field": (_story(lambda s: s.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "export_counts": (
        _story(lambda s: s.characters().agg(F.lit("characters").alias("name"), F.count("*").alias("n")).unionByName(s.relations().agg(F.lit("relations").alias("name"), F.count("*").alias("n"))).unionByName(s.issues().agg(F.lit("issues").alias("name"), F.count("*").alias("n")))),
        SQL + "SELECT 'characters' AS name, count(*) AS n FROM characters UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'issues', count(*) FROM issues",
    ),
    "export_rows": (
        _story(lambda s: s.groups().select(F.lit("groups").alias("name"), F.to_json(F.struct("id", "name"), {"ignoreNullFields": "false"}).alias("json")).unionByName(s.characters().select(F.lit("characters").alias("name"), F.to_json(F.struct("id", "name", "era"), {"ignoreNullFields": "false"}).alias("json")))),
        SQL + "SELECT 'groups' AS name, CAST(json_object('id', id, 'name', name) AS VARCHAR) AS json FROM groups UNION ALL SELECT 'characters', CAST(json_object('id', id, 'name', name, 'era', era) AS VARCHAR) FROM characters",
    ),
    "sse_rendered": (
        _story(lambda s: S.to_sse(s.table("events").select("event_id", F.col("event_type").alias("event"), F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"))).select("event_id", F.col("sse").alias("message"))),
        "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"event_id\":' || event_id || CASE WHEN user_id % 4 <> 0 THEN ',\"user_id\":' || user_id ELSE '' END || '}' || chr(10) || chr(10) AS message FROM events",
    ),
}
