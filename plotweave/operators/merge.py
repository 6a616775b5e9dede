"""Key-based upserts and deletes as DataFrame functions.

``upsert`` joins the present table with a batch of updates on its key; a rule for each column says what wins. Applying
the same batch twice gives what applying it once does, except for ``append``; ``extend`` appends what is not there yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import text as T

#: Column rules: value of a row that exists before (old) and in the batch (new).
RULES = {
    "keep": lambda old, new: old,
    "fill": lambda old, new: F.coalesce(old, new),
    "overwrite": lambda old, new: new,
    "patch": lambda old, new: F.coalesce(T.null_if_blank(new), old),
    "append": lambda old, new: F.coalesce(F.concat(old, F.lit(". "), T.null_if_blank(new)), T.null_if_blank(new), old),
    "extend": lambda old, new: F.when(F.contains(F.concat(F.lit(". "), old, F.lit(". ")), F.concat(F.lit(". "), new, F.lit(". "))), old).otherwise(RULES["append"](old, new)),
    "union": lambda old, new: F.when(new.isNull(), old).otherwise(F.array_union(F.coalesce(old, F.array().cast("array<string>")), new)),
}


def last_by_key(updates: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the highest ``order``, and of several the one whose other columns come last."""
    rest = [F.col(c).desc_nulls_last() for c, kind in updates.dtypes if c != order and not kind.startswith("map")]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), *rest))
    return updates.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(existing: DataFrame, updates: DataFrame, key: list[str], rules: dict[str, str], blank_is_null: bool = False) -> DataFrame:
    """The table after the batch; columns without a rule keep the old value where there is one.

    ``updates`` has one row per key and may lack columns, which then stay as they are (null for new rows). Keys are
    compared null-safely, so a null key is a key like any other.
    """
    have = set(updates.columns)
    new = updates.select(*[F.col(c).alias(f"__new_{c}") for c in updates.columns], F.lit(True).alias("__in_new"))
    old = existing.withColumn("__in_old", F.lit(True))
    match: Column = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"__new_{k}"))
    joined = old.join(new, match, "full_outer")
    both, only_new = F.col("__in_old").isNotNull() & F.col("__in_new").isNotNull(), F.col("__in_old").isNull()
    out = []
    for c in existing.columns:
        if c not in have:
            out.append(F.col(c))
            continue
        value = F.col(f"__new_{c}")
        if blank_is_null and c not in key and dict(existing.dtypes)[c] == "string":
            value = T.null_if_blank(value)
        merged = RULES[rules.get(c, "keep")](F.col(c), value)
        out.append(F.when(only_new, value).when(both, merged).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def overwrite_present(existing: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Set a field exactly where the update's map ``changes`` has its key, to null if the value is null; add no rows."""
    new = updates.select(F.col(key).alias("__k"), F.col("changes").alias("__changes"))
    joined = existing.join(new, existing[key] == F.col("__k"), "left")
    held = lambda c: F.coalesce(F.map_contains_key("__changes", F.lit(c)), F.lit(False))
    return joined.select(*[F.when(held(c), F.try_element_at("__changes", F.lit(c))).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns])


def with_endpoints(edges: DataFrame, *ends: tuple[str, DataFrame, str]) -> DataFrame:
    """Edges whose ends all exist: (edge column, node table, node id)."""
    for column, nodes, node_id in ends:
        ids = nodes.select(F.col(node_id).alias(f"__{column}")).distinct()
        edges = edges.join(ids, F.col(column) == F.col(f"__{column}"), "left_semi")
    return edges


def undirected_key(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The two ends of each edge in order."""
    return edges.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def delete_where(existing: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The table without the rows whose key is in ``keys``."""
    return existing.join(keys.select(*on).distinct(), on, "left_anti")


def delete_counted(existing: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The keys to delete, once each, and whether the table had (and so loses) a row of it."""
    there = existing.select(*on).distinct().withColumn("__there", F.lit(True))
    return keys.select(*on).distinct().join(there, on, "left").select(*on, F.coalesce("__there", F.lit(False)).alias("deleted"))


def delete_scenes(tables: dict[str, DataFrame], ids: DataFrame, references: dict[str, str]) -> dict[str, DataFrame]:
    """All tables without the rows that refer to these scenes; ``references``: table to its scene column."""
    return {n: t.join(ids.select(F.col("id").alias("__id")).distinct(), t[references[n]] == F.col("__id"), "left_anti") if n in references else t for n, t in tables.items()}


def scenes_of_stem(scenes: DataFrame, stem: str, exact: bool = True, id_col: str = "id") -> DataFrame:
    """Scenes of one file: its own id and its chunks', or (``exact=False``) every id that begins so."""
    name = f"scene-{stem}"
    if not exact:
        return scenes.where(F.col(id_col).startswith(name))
    return scenes.where((F.col(id_col) == name) | F.col(id_col).startswith(f"{name}-chunk-"))
