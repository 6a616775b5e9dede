"""Connected components of a link table, by contraction; nothing of it comes to the driver but row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns a, b, both long): equal roots mean connected.

    Each round points every node at the neighbour (or itself) that comes first in a random order of that round and
    replaces the ends of all links by what they point at, so a constant share of the nodes goes per round, on chains
    as on stars. Links that have become loops or repeats go. At the end the pointers are followed back. Each round is
    written to the shared folder, so lineage stays short.
    """
    edges = scratch.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        n = len(pointers)
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("rank"), F.col(c).alias("node"))  # noqa: E731, B023
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        pointer = scratch.save(first.select(F.col("a").alias("node"), F.least("best", order("a"))["node"].alias("to")), f"pointers-{n}")
        pointers.append(pointer)
        left = pointer.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = pointer.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").where("to_a <> to_b")
        edges = scratch.save(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"edges-{n + 1}")
        scratch.drop(f"edges-{n}")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pointers[-1].select("node", F.col("to").alias("root"))
    for pointer in reversed(pointers[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = pointer.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return scratch.save(roots, "roots")
