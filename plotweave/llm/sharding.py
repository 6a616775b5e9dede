"""Sharding (operator 3): proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within their source by a seeded hash and ranked there; a row of rank r among n gets the fraction
(r - 1 + u) / n, with u in [0, 1) a hash of the source, and the order of the fractions is cut into shards of equal row
counts. Every stretch of that order has of each source its share, to within one row.

Ranks are never taken over a whole source or table in one task. The hash (and later the fraction) is cut into about
sqrt(rows) equal buckets, a row's rank is its number within the bucket plus the rows in the buckets before, and only the
bucket counts are summed up in order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import Scratch

#: Rows in a bucket on average, at least.
LEAST_BUCKET = 256


def _free(names: tuple[str, ...], taken: set[str]) -> list[str]:
    """The names, each with ``_in`` behind it as often as it takes to be like no other."""
    out: list[str] = []
    for name in names:
        new = name
        while new in taken or new in out or (new != name and new in names):
            new += "_in"
        out.append(new)
    return out


def interleave(
    docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` and the columns of ``carry``, one row for each row of ``docs``.

    A column of ``carry`` that is named like one of these comes back as ``<name>_in``.

    ``size``: UTF-8 bytes of the text plus 16; ``text_crc32``: its unsigned CRC-32; a null text counts as empty. Shards
    0 to ``shards`` - 1 differ by at most one row; ``slot`` counts from 0 in each. Null sources are a source of their own.
    The order depends on the seed, the id, the source and the text; rows that repeat all of these take neighbouring
    places in any order. Columns of ``docs`` that are not named are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.crc32(text).cast("string"), source).cast("binary"))
    n = docs.count()
    buckets = max(1, n // max(LEAST_BUCKET, math.isqrt(n)))
    kept = [F.col(c).alias(f"__carry_{c}") for c in carry]
    fraction = lambda hexadecimal: F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = docs.select(
        F.col(id_col).alias("__id"), (F.length(text) + 16).cast("long").alias("__size"), F.crc32(text).alias("__crc"), source.alias("__source"), draw.alias("__draw"), *kept
    ).withColumn("__bucket", F.floor(fraction("__draw") * buckets))

    counts = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    in_order = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    strata = counts.select(
        "__source", "__bucket", F.coalesce(F.sum("__n").over(in_order), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__source")).alias("__total")
    )
    within = Window.partitionBy("__source", "__bucket").orderBy("__draw", "__id", "__crc", "__size")
    ranked = rows.withColumn("__rank", F.row_number().over(within)).join(strata, ["__source", "__bucket"])
    share = (F.col("__before") + F.col("__rank") - 1 + fraction(F.md5(F.concat(F.lit(f"{seed}/"), F.col("__source")).cast("binary")))) / F.col("__total")
    placed = scratch.save(
        ranked.withColumn("__share", share).withColumn("__part", F.least(F.floor(F.col("__share") * buckets), F.lit(buckets - 1))).drop("__bucket", "__draw", "__rank", "__before", "__total"),
        "placed",
    )

    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    order = Window.partitionBy("__part").orderBy("__share", "__source", "__id", "__crc", "__size")
    position = placed.withColumn("__rank", F.row_number().over(order)).join(before, "__part").withColumn("__at", F.col("__before") + F.col("__rank") - 1)
    cut = position.withColumn("__shard", F.expr(f"__at * {shards} div {max(n, 1)}")).withColumn("__first", F.expr(f"(__shard * {n} + {shards - 1}) div {shards}"))
    return cut.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__at") - F.col("__first")).alias("slot"),
        *[F.col(f"__carry_{c}").alias(name) for c, name in zip(carry, _free(carry, {id_col, "size", "text_crc32", "shard", "slot"}), strict=True)],
    )
