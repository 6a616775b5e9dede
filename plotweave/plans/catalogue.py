"""All named queries of the story operators, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotweave.plans import checks, lookups, matching, streams, temporal, texts, writes

MODULES = (checks, lookups, writes, texts, matching, streams, temporal)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, (run, _) in module.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.PLANS.items() if sql}
