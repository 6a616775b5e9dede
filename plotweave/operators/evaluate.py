"""Evaluation of a loaded store: named lookups, checks of their rows, and run history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators import lookups, metrics


def _by(table: str, column: str) -> Callable[..., DataFrame]:
    return lambda store, **p: store.read(table).where(F.col(column) == p[column]) if column in p else store.read(table)


def _fragments(store, character_id: str, role: str | None = None) -> DataFrame:
    rows = store.read("presence").where(F.col("character_id") == character_id)
    return rows if role is None else rows.where(F.col("role") == role)


def _relations(store, character_id: str) -> DataFrame:
    return lookups.relations_of(store.read("relations"), store.read("characters")).where(F.col("id") == character_id)


#: Named lookups: a function of the store and the case's parameters.
QUERIES: dict[str, Callable[..., DataFrame]] = {
    "characters": _by("characters", "id"),
    "locations": _by("locations", "id"),
    "groups": _by("groups", "id"),
    "scenes": _by("scenes", "id"),
    "events": _by("events", "era"),
    "issues": _by("issues", "type"),
    "beats": _by("beats", "scene_id"),
    "members": _by("members", "group_id"),
    "participants": _by("participants", "event_id"),
    "chunk_links": _by("next_chunks", "from_id"),
    "vectors": _by("vectors", "id"),
    "group_presence": _by("group_presence", "group_id"),
    "event_places": _by("event_locations", "event_id"),
    "beat_people": _by("beat_characters", "beat_id"),
    "issue": _by("issues", "id"),
    "profile": _by("characters", "id"),
    "relation_types": lambda store, **p: lookups.relation_types(store.read("relations"), p["a"], p["b"]),
    "fragments": _fragments,
    "relations": _relations,
    "present": lambda store, **p: store.read("presence").where(F.col("role") != "mentioned"),
    "profile_texts": lambda store, **p: store.read("characters").select("id", F.array_join(F.filter(F.array("background", "arc", "traits"), lambda x: F.coalesce(x, F.lit("")) != ""), " | ").alias("text")),
    "filled_fields": lambda store, **p: store.read("characters").select("id", F.map_keys(F.map_filter(F.create_map(*[x for c in ("age", "physical", "background", "arc", "traits") for x in (F.lit(c), F.col(c))]), lambda _, v: F.coalesce(v, F.lit("")) != "")).alias("fields")),
}


@dataclass
class Case:
    """A lookup with its parameters and what its rows must meet: (kind, arguments)."""

    name: str
    query: str
    parameters: dict = field(default_factory=dict)
    check: tuple = ("at_least", 1)


def _texts(column: str) -> Column:
    return F.collect_list(F.coalesce(F.col(column).cast("string"), F.lit("")))


def verdict(rows: DataFrame, check: tuple) -> DataFrame:
    """One row ``passed, score``. Kinds: exactly, at_least, at_most (row counts); recall, absent, keywords, all_contain (a
    column and values; accents and case do not count); one_of (a column and values that all its rows must be among)."""
    kind, *args = check
    if kind in ("exactly", "at_least", "at_most"):
        n = F.count("*")
        return rows.agg(metrics.within(n, **{kind: args[0]}).alias("passed"), n.cast("double").alias("score"))
    column, values = args
    wanted = F.array(*[F.lit(v) for v in values])
    if kind == "recall":
        score = metrics.recall(wanted, F.col("found"))
        return rows.agg(_texts(column).alias("found")).select((score == 1.0).alias("passed"), score.cast("double").alias("score"))
    if kind == "keywords":
        score = metrics.keyword_score(F.array_join("found", "\n"), wanted)
        return rows.agg(_texts(column).alias("found")).select((score == 1.0).alias("passed"), score.cast("double").alias("score"))
    if kind == "absent":
        bad = F.count_if(F.col(column).isin(*values))
        return rows.agg((bad == 0).alias("passed"), bad.cast("double").alias("score"))
    held = F.col(column).isin(*values) if kind == "one_of" else metrics.keyword_score(F.col(column), wanted) == 1.0
    bad = F.count_if(~F.coalesce(held, F.lit(False)))
    return rows.agg((bad == 0).alias("passed"), bad.cast("double").alias("score"))


def run_cases(store, cases: list[Case]) -> DataFrame:
    """``case_name, query, passed, score``: one small aggregation per case, in one plan."""
    parts = [verdict(QUERIES[c.query](store, **c.parameters), c.check).select(F.lit(c.name).alias("case_name"), F.lit(c.query).alias("query"), "passed", "score") for c in cases]
    return reduce(DataFrame.unionByName, parts)


def tagged(cases: DataFrame, tags: list[str]) -> DataFrame:
    """Cases whose category or any tag is wanted."""
    return cases.where(F.col("category").isin(*tags) | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def all_tags(cases: DataFrame) -> DataFrame:
    """Every category and tag, once."""
    return cases.select(F.explode(F.array_union("tags", F.array("category"))).alias("tag")).distinct()


def runs_by_case(history: DataFrame) -> DataFrame:
    """Per model, suite and case: runs and passes, from the history's maps."""
    return history.select("model", "suite", F.explode("cases").alias("case_name", "passed")).groupBy("model", "suite", "case_name").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"))


def tail(history: DataFrame, n: int) -> DataFrame:
    """The last ``n`` runs."""
    return history.orderBy(F.desc("ts"), "suite", "model").limit(n)


def durations(history: DataFrame) -> DataFrame:
    """Per model, suite and case: how often its time is known, its mean and its longest time."""
    timed = history.select("model", "suite", F.explode("case_durations").alias("case_name", "seconds")).where("seconds IS NOT NULL")
    return timed.groupBy("model", "suite", "case_name").agg(F.count("*").alias("runs"), F.avg("seconds").alias("mean_s"), F.max("seconds").alias("longest_s"))


def pass_lists(history: DataFrame) -> DataFrame:
    """Each run with the sorted names of its cases that passed and that failed."""
    names = lambda want: F.array_sort(F.map_keys(F.map_filter("cases", lambda _, v: v == F.lit(want))))
    return history.select("ts", "suite", "model", names(True).alias("passed_cases"), names(False).alias("failed_cases"))
