"""Folds over event logs (family Q) over the analogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.plans.lookups import _story
from plotweave.sources import files
from plotweave.streaming import imports

LOG = """
WITH log AS (
  SELECT CAST(user_id AS VARCHAR) AS import_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'scene_loaded' WHEN 'error' THEN 'scene_error' WHEN 'signup' THEN 'issue_found' WHEN 'purchase' THEN 'done' ELSE 'status_change' END AS event,
    CASE WHEN event_id % 3 = 0 THEN event_type END AS status, CASE WHEN event_id % 5 = 0 THEN props END AS file, CAST(NULL AS VARCHAR) AS scene_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS INTEGER) END AS processed,
    CAST(100 AS INTEGER) AS total, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS message FROM events)
"""


def _log(s):
    kind, n = F.col("event_type"), F.col("event_id")
    event = F.when(kind == "view", "scene_loaded").when(kind == "error", "scene_error").when(kind == "signup", "issue_found").when(kind == "purchase", "done").otherwise("status_change")
    return s.table("events").select(
        F.col("user_id").cast("string").alias("import_id"), n.alias("seq"), event.alias("event"), F.when(n % 3 == 0, kind).alias("status"), F.when(n % 5 == 0, F.col("props")).alias("file"), F.lit(None).cast("string").alias("scene_id"),
        F.when(n % 2 == 0, (n % 100).cast("int")).alias("processed"), F.lit(100).alias("total"), F.when(kind == "error", F.concat(F.lit("failed "), n.cast("string"))).alias("message"),
    )


def _bodies(s):
    return s.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("event: "), x["role"], F.lit("\r\ndata: {\r\ndata: "), x["turn"].cast("string"), F.lit("}"))), "\r\n\r\n").alias("body"))


def _sse(s):
    return files.parse_sse(_bodies(s), "conv_id", "body")


def _sse_chunks(s):
    """The same bodies, cut after every seventh character."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 7).cast("int")), lambda i: F.substring("body", i * 7 + 1, F.lit(7)))
    return files.parse_sse_chunks(_bodies(s).select("conv_id", F.posexplode(cut).alias("n", "chunk")), "conv_id", "n", "chunk")


SSE_SQL = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS pos, role AS event, '{' || chr(10) || turn || '}' AS data FROM conversations"


PLANS = {
    "progress_fold": (
        _story(lambda s: imports.fold_progress(_log(s))),
        LOG + """SELECT import_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(file, seq) FILTER (file IS NOT NULL) AS file, CAST(NULL AS VARCHAR) AS scene_id,
  arg_max(processed, seq) FILTER (processed IS NOT NULL) AS processed, arg_max(total, seq) AS total, arg_max(message, seq) FILTER (message IS NOT NULL) AS message,
  count(*) FILTER (event = 'scene_loaded') AS scenes_loaded, count(*) FILTER (event = 'issue_found') AS issues_found, count(*) FILTER (event = 'scene_error') AS scenes_failed, bool_or(event = 'done') AS ended FROM log GROUP BY import_id""",
    ),
    "sse_messages": (_story(_sse), SSE_SQL),
    "sse_chunks": (_story(_sse_chunks), SSE_SQL),
}
