"""Vector search, entity resolution and metrics (families N, L and R) over the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import evaluate as V
from plotweave.operators import metrics as R
from plotweave.operators import resolve as E
from plotweave.operators import search as N
from plotweave.plans.lookups import _story
from plotweave.plans.story import SQL

QUERY = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]
LIST = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY) + "]"
DISTANCE = f"list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {LIST}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

_vectors = lambda s: s.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("era"))
_rounded = lambda df: df.select("id", F.round("distance", 6).alias("distance"))


def _registry(s):
    return s.characters().select("id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def _mentions(s):
    key = F.col("c_custkey")
    wrong = F.concat(F.lit("Suplier#"), F.lpad((key % 150).cast("string"), 9, "0"))
    return s.table("customer").select(key.alias("mention"), F.when(key % 3 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((key % 150).cast("string"), 9, "0"))).when(key % 3 == 1, F.concat(F.lit("s-"), (key % 150).cast("string"))).otherwise(wrong).alias("name"))


def _in_order(s):
    """Part names as mentions, in 25 stories by brand, in the order of their keys; suppliers are the story's known people."""
    story = lambda c: F.concat(F.lit("Brand#"), F.floor(c / 5 % 5 + 1).cast("string"), (c % 5 + 1).cast("string"))
    mentions = s.table("part").select(F.col("p_brand").alias("story"), F.col("p_partkey").alias("at"), F.col("p_name").alias("name"))
    registry = _registry(s).select(story(F.col("id")).alias("story"), F.col("id").cast("string").alias("id"), "name", "aliases")
    answers = s.table("part").select(F.col("p_name").alias("name"), F.when(F.crc32(F.col("p_name").cast("binary")) % 3 == 0, "new").when(F.crc32(F.col("p_name").cast("binary")) % 3 == 1, "link").alias("answer")).where("answer IS NOT NULL").distinct()
    return mentions, registry, answers


def _relations(s):
    """Part names as relations; 40 parts with successive keys are a pair's, so pairs grow with the table."""
    return s.table("part").select(F.floor(F.col("p_partkey") / 40).alias("pair"), F.col("p_name").alias("relation"), "p_partkey", "p_brand")


def _cases(s):
    """Runs of an evaluation: a day is a run, an event type a suite, a user a case, passed if its last value is high."""
    return s.table("events").select(F.col("event_type").alias("suite"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.col("user_id").alias("kase"), "value", "event_id").groupBy("suite", "ts", "kase").agg((F.max("value") > 20).alias("passed"))


def _history(s):
    return _cases(s).groupBy("suite", "ts").agg(F.map_from_entries(F.collect_list(F.struct(F.col("kase").cast("string"), "passed"))).alias("cases")).withColumn("model", F.concat(F.lit("m"), F.length("suite").cast("string")))


def _tagged(s):
    return s.table("events").select("event_id", F.col("event_type").alias("category"), F.array(F.when(F.col("value") > 50, "high").otherwise("low"), F.lit("all")).alias("tags"))


CASES = "WITH cases AS (SELECT event_type AS suite, strftime(ts, '%Y-%m-%d') AS ts, user_id AS kase, max(value) > 20 AS passed FROM events GROUP BY ALL)"

PLANS = {
    "vector_topk": (_story(lambda s: _rounded(N.nearest(_vectors(s), QUERY, 5))), f"SELECT id, round(distance, 6) AS distance FROM (SELECT vec_id AS id, {DISTANCE} AS distance FROM embeddings ORDER BY distance, id LIMIT 5)"),
    "vector_topk_filtered": (_story(lambda s: _rounded(N.nearest(_vectors(s), QUERY, 5, N.metadata_filter(era="3")))), f"SELECT id, round(distance, 6) AS distance FROM (SELECT vec_id AS id, {DISTANCE} AS distance FROM embeddings WHERE label = 3 ORDER BY distance, id LIMIT 5)"),
    "related_scenes": (_story(lambda s: _rounded(N.related(_vectors(s), QUERY, 20))), f"SELECT id, round(distance, 6) AS distance FROM (SELECT * FROM (SELECT vec_id AS id, {DISTANCE} AS distance FROM embeddings ORDER BY distance, id LIMIT 11) WHERE id <> 20 ORDER BY distance, id LIMIT 10)"),
    "vector_topk_each": (
        _story(lambda s: N.nearest_each(_vectors(s), _vectors(s).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 3).select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")),
        "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v JOIN v q ON q.vec_id % 20 = 0) SELECT query_id, id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 3",
    ),
    "exact_resolution": (
        _story(lambda s: E.resolve(_mentions(s), _registry(s)).where("status = 'exact'").select("mention", "status", "entity_id")),
        SQL + ", m AS (SELECT c_custkey AS mention, CASE WHEN c_custkey % 3 = 0 THEN 'supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') ELSE 's-' || c_custkey % 150 END AS norm FROM customer WHERE c_custkey % 3 <> 2), n AS (SELECT lower(name) AS norm, false AS al, id FROM characters UNION ALL SELECT lower(unnest(aliases)), true, id FROM characters) SELECT mention, 'exact' AS status, CAST(arg_min(id, (al, id)) AS VARCHAR) AS entity_id FROM m JOIN n USING (norm) GROUP BY mention",
    ),
    "fuzzy_resolution": (_story(lambda s: E.resolve(_mentions(s), _registry(s)).select("mention", "status", "entity_id", "entity_name", F.round("score", 4).alias("score"))), None),
    "resolution_in_order": (
        _story(lambda s: E.resolve_in_order(*_in_order(s)[:2], "at", _in_order(s)[2], scope="story").select("story", F.col("at").alias("mention"), "status", "entity_id", "entity_name", F.round("score", 4).alias("score"), "told_apart")),
        None,
    ),
    "group_resolution": (
        _story(lambda s: E.resolve_groups(s.table("nation").select(F.col("n_nationkey").alias("mention"), F.when(F.col("n_nationkey") < 5, F.element_at(F.array(*[F.lit(x) for x in ("africa", "Ásia", "EUROPE", "Nowhere Land", "AMERICA ")]), F.col("n_nationkey") + 1)).otherwise(F.col("n_name")).alias("name")), s.groups())),
        SQL + ", m AS (SELECT n_nationkey AS mention, CASE WHEN n_nationkey < 5 THEN (['africa', 'Ásia', 'EUROPE', 'Nowhere Land', 'AMERICA '])[n_nationkey + 1] ELSE n_name END AS name FROM nation) SELECT mention, m.name, coalesce(CAST(g.id AS VARCHAR), trim(regexp_replace(lower(strip_accents(m.name)), '[^a-z0-9]+', '-', 'g'), '-')) AS group_id, g.id IS NULL AS is_new FROM m LEFT JOIN groups g ON lower(g.name) = trim(lower(strip_accents(m.name)))",
    ),
    "relation_dedup_band": (
        _story(lambda s: E.relation_duplicates(_relations(s).withColumn("relation", F.concat_ws(" ", "relation", "p_brand")).drop("p_brand"), _relations(s), ["pair"]).select("p_partkey", "best", F.round("best_score", 4).alias("score"), "band")),
        None,
    ),
    "policy_actions": (
        _story(lambda s: E.apply_policy(s.table("customer").select(F.col("c_custkey").alias("mention"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "ambiguous").otherwise("resolved").alias("status")), s.table("customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 == 0, "new").otherwise("link").alias("answer")))),
        "SELECT c_custkey AS mention, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN c_custkey % 2 = 1 THEN 'resolved' WHEN c_custkey % 9 = 0 THEN 'create' WHEN c_custkey % 3 = 0 THEN 'link_alias' ELSE 'link' END AS action, CASE WHEN c_custkey % 2 = 0 THEN 'duplicate_suspect' END AS issue_type, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN 'info' ELSE 'warning' END END AS issue_severity, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0 END AS issue_resolved FROM customer",
    ),
    "recall_metric": (
        _story(lambda s: s.presence().groupBy("character_id").agg(F.collect_set(F.when(F.col("role") == "R", F.col("scene_id") % 50)).alias("e"), F.collect_set(F.when(F.col("role") == "A", F.col("scene_id") % 50)).alias("f")).select("character_id", F.round(R.recall(F.col("e"), F.col("f")), 6).alias("recall"))),
        "WITH e AS (SELECT l_suppkey AS character_id, list_distinct(list(l_orderkey % 50) FILTER (l_returnflag = 'R')) AS e, list_distinct(list(l_orderkey % 50) FILTER (l_returnflag = 'A')) AS f FROM lineitem GROUP BY 1) SELECT character_id, round(CASE WHEN e IS NULL OR len(e) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, f)) / len(e)::DOUBLE END, 6) AS recall FROM e",
    ),
    "keyword_score": (
        _story(lambda s: s.table("documents").select("doc_id", F.round(R.keyword_score(F.col("text"), F.array(F.lit("THE"), F.lit("été"), F.lit("ción"), F.lit("und"))), 4).alias("score"))),
        "SELECT doc_id, (contains(t, 'the')::INT + contains(t, 'ete')::INT + contains(t, 'cion')::INT + contains(t, 'und')::INT) / 4.0::DOUBLE AS score FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)",
    ),
    "role_accuracy": (
        _story(lambda s: R.role_accuracy(s.presence().where("role <> 'N'").select("scene_id", "character_id", "role").dropDuplicates(["scene_id", "character_id", "role"]), s.presence().select("scene_id", "character_id", F.col("role").alias("role")).where("character_id % 3 <> 0"), "scene_id", "character_id", "role").withColumn("accuracy", F.round("accuracy", 6))),
        "WITH e AS (SELECT DISTINCT l_orderkey AS scene_id, l_suppkey AS c, l_returnflag AS role FROM lineitem WHERE l_returnflag <> 'N'), f AS (SELECT l_orderkey AS scene_id, l_suppkey AS c, min(l_returnflag) AS got FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL) SELECT scene_id, count(*) AS total, count(*) FILTER (got = role) AS correct, count(*) FILTER (got IS NULL) AS missing, count(*) FILTER (got <> role) AS wrong, round(count(*) FILTER (got = role) / count(*)::DOUBLE, 6) AS accuracy FROM e LEFT JOIN f USING (scene_id, c) GROUP BY scene_id",
    ),
    "run_history_summary": (
        _story(lambda s: R.run_summary(_cases(s), ["suite", "ts"], "passed").select("suite", "ts", "passed", "total", "percent", "band")),
        CASES + " SELECT suite, ts, count(*) FILTER (passed) AS passed, count(*) AS total, round_even(count(*) FILTER (passed) / count(*)::DOUBLE * 100, 1) AS percent, CASE WHEN count(*) FILTER (passed) / count(*)::DOUBLE >= 0.8 THEN 'green' WHEN count(*) FILTER (passed) / count(*)::DOUBLE >= 0.5 THEN 'yellow' ELSE 'red' END AS band FROM cases GROUP BY suite, ts",
    ),
    "runs_by_case": (
        _story(lambda s: V.runs_by_case(_history(s))),
        CASES + " SELECT 'm' || len(suite) AS model, suite, CAST(kase AS VARCHAR) AS case_name, count(*) AS runs, count(*) FILTER (passed) AS passes FROM cases GROUP BY ALL",
    ),
    "history_tail": (_story(lambda s: V.tail(_history(s), 7).select("ts", "suite", "model")), CASES + " SELECT ts, suite, 'm' || len(suite) AS model FROM (SELECT DISTINCT ts, suite FROM cases) ORDER BY ts DESC, suite LIMIT 7"),
    "cases_by_tag": (
        _story(lambda s: V.tagged(_tagged(s), ["click", "high"]).select("event_id")),
        "SELECT event_id FROM events WHERE event_type = 'click' OR value > 50",
    ),
    "tag_facet": (_story(lambda s: V.all_tags(_tagged(s))), "SELECT DISTINCT tag FROM (SELECT event_type AS tag FROM events UNION ALL SELECT CASE WHEN value > 50 THEN 'high' ELSE 'low' END FROM events UNION ALL SELECT 'all')"),
    "id_set_difference": (
        _story(lambda s: s.presence().where("role = 'R'").select("scene_id").exceptAll(s.issues().where("scene_id IS NOT NULL").select("scene_id")).distinct().subtract(s.issues().select("scene_id"))),
        SQL + "SELECT DISTINCT scene_id FROM presence WHERE role = 'R' AND scene_id NOT IN (SELECT scene_id FROM issues WHERE scene_id IS NOT NULL)",
    ),
    "present_not_mentioned": (_story(lambda s: s.presence().where("role <> 'N'").groupBy("scene_id").agg(F.countDistinct("character_id").alias("n"))), SQL + "SELECT scene_id, count(DISTINCT character_id) AS n FROM presence WHERE role <> 'N' GROUP BY scene_id"),
    "run_diff_last_two": (
        _story(lambda s: R.diff_last_two(_cases(s), "suite", "ts", "kase", "passed")),
        CASES + ", runs AS (SELECT suite, ts, row_number() OVER (PARTITION BY suite ORDER BY ts DESC) AS n FROM (SELECT DISTINCT suite, ts FROM cases)), a AS (SELECT suite, kase, passed AS now FROM cases JOIN runs USING (suite, ts) WHERE n = 1), b AS (SELECT suite, kase, passed AS before FROM cases JOIN runs USING (suite, ts) WHERE n = 2) SELECT suite, kase, now, before, CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN now = before THEN '=' WHEN now THEN '+' ELSE '-' END AS change FROM a FULL JOIN b USING (suite, kase)",
    ),
}
