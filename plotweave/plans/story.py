"""The driver's tables seen as story tables.

supplier: character (a supplier whose key is divisible by 7 has no era, its aliases are made from its key);
orders: scene; lineitem: presence of a character in a scene, with the return flag as role; nation: location (a scene's,
through the customer) with its region as era; region: group, of which a supplier is a member through its nation;
suppliers of one order with one line status: related; events: timeline event (era: its type), placed at the nation
user mod 25 unless user mod 3 is 0, with the supplier event mod 50 and, for even events, the one after it as
participants; error events: issues. ``SQL`` holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Story:
    """The views over one data set."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def characters(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("id"),
            F.col("s_name").alias("name"),
            F.when(key % 7 != 0, F.concat(F.lit("19"), F.lpad((F.col("s_nationkey") % 10 * 10).cast("string"), 2, "0"), F.lit("s"))).alias("era"),
            F.when(key % 5 != 0, F.array(F.concat(F.lit("The "), (key % 13).cast("string"), F.lit("th Trader")), F.concat(F.lit("S-"), key.cast("string")))).alias("aliases"),
            F.col("s_nationkey").alias("nation"),
            F.col("s_acctbal").alias("balance"),
        )

    def locations(self) -> DataFrame:
        regions = self.table("region")
        return self.table("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("era"))

    def groups(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    def members(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("character_id"), F.col("n_regionkey").alias("group_id"))

    def scenes(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("scene_id"), "date", F.col("c_nationkey").alias("location_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status")
        )

    def presence(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("character_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("role"))

    def relations(self) -> DataFrame:
        one = self.table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"), F.col("l_linestatus").alias("s"))
        two = one.select("l_orderkey", F.col("a").alias("b"), F.col("s").alias("t"))
        return one.join(two, "l_orderkey").where("a < b AND s = t").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("s").alias("relation_type")).distinct()

    def events(self) -> DataFrame:
        return self.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("era"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"))

    def event_locations(self) -> DataFrame:
        return self.table("events").where("user_id % 3 <> 0").select("event_id", (F.col("user_id") % 25).cast("int").alias("location_id"))

    def participants(self) -> DataFrame:
        first = self.table("events").select("event_id", (F.col("event_id") % 50).alias("character_id"))
        return first.unionByName(first.where("event_id % 2 = 0").select("event_id", (F.col("character_id") + 1).alias("character_id")))

    def issues(self) -> DataFrame:
        return self.table("events").where("event_type = 'error'").select(
            F.col("event_id").alias("issue_id"),
            F.when(F.col("event_id") % 3 == 0, "timeline_inconsistency").when(F.col("event_id") % 3 == 1, "missing_info").otherwise("bilocalization").alias("type"),
            F.when(F.col("value") > 50, "error").when(F.col("value") > 10, "warning").otherwise("info").alias("severity"),
            F.when(F.col("event_id") % 11 != 0, F.col("event_id") * 7 % 20000).alias("scene_id"),
            F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4 == 1).alias("resolved"),
            F.col("ts").alias("created_at"),
        )

    def beats(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat_ws("-beat-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("beat_id"),
            F.col("l_orderkey").alias("scene_id"), F.col("l_linestatus").alias("action"), F.col("l_suppkey").alias("subject_id"),
            F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 100).alias("object_id"),
        )

    def chunks(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("stem"), F.col("turn").alias("idx"), F.concat(F.lit("scene-"), F.col("conv_id").cast("string"), F.lit("-chunk-"), F.lpad(F.col("turn").cast("string"), 2, "0")).alias("id"), "role", "text")


SQL = """
WITH characters AS (
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN '19' || lpad(CAST(s_nationkey % 10 * 10 AS VARCHAR), 2, '0') || 's' END AS era,
    CASE WHEN s_suppkey % 5 <> 0 THEN ['The ' || s_suppkey % 13 || 'th Trader', 'S-' || s_suppkey] END AS aliases, s_nationkey AS nation, s_acctbal AS balance FROM supplier),
locations AS (SELECT n_nationkey AS id, n_name AS name, r_name AS era FROM nation JOIN region ON n_regionkey = r_regionkey),
groups AS (SELECT r_regionkey AS id, r_name AS name FROM region),
members AS (SELECT s_suppkey AS character_id, n_regionkey AS group_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
scenes AS (
  SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS date, c_nationkey AS location_id, o_orderpriority AS title, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey),
presence AS (SELECT l_suppkey AS character_id, l_orderkey AS scene_id, l_returnflag AS role FROM lineitem),
relations AS (
  SELECT DISTINCT a.l_suppkey AS id_a, b.l_suppkey AS id_b, a.l_linestatus AS relation_type
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey AND a.l_linestatus = b.l_linestatus),
timeline_events AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, event_type AS era, event_type || ' ' || event_id AS title FROM events),
event_locations AS (SELECT event_id, user_id % 25 AS location_id FROM events WHERE user_id % 3 <> 0),
participants AS (SELECT event_id, event_id % 50 AS character_id FROM events UNION ALL SELECT event_id, event_id % 50 + 1 FROM events WHERE event_id % 2 = 0),
issues AS (
  SELECT event_id AS issue_id, CASE event_id % 3 WHEN 0 THEN 'timeline_inconsistency' WHEN 1 THEN 'missing_info' ELSE 'bilocalization' END AS type,
    CASE WHEN value > 50 THEN 'error' WHEN value > 10 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN event_id % 11 <> 0 THEN event_id * 7 % 20000 END AS scene_id,
    CASE WHEN event_id % 4 <> 0 THEN event_id % 4 = 1 END AS resolved, ts AS created_at FROM events WHERE event_type = 'error'),
beats AS (
  SELECT l_orderkey || '-beat-' || l_linenumber AS beat_id, l_orderkey AS scene_id, l_linestatus AS action, l_suppkey AS subject_id,
    CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 100 END AS object_id FROM lineitem),
chunks AS (SELECT conv_id AS stem, turn AS idx, 'scene-' || conv_id || '-chunk-' || lpad(CAST(turn AS VARCHAR), 2, '0') AS id, role, text FROM conversations)
"""
