"""Evaluation metrics and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import text as T


def recall(expected: Column, found: Column) -> Column:
    """Share of the expected values that were found; 1 if none is expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def keyword_score(text: Column, keywords: Column) -> Column:
    """Share of the keywords that the text contains, accents and case ignored; 1 if there is none."""
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(T.holds_each(text, keywords)) / F.size(keywords))


def mutually_contained(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def within(value: Column, at_least: int | None = None, at_most: int | None = None, exactly: int | None = None) -> Column:
    """Whether a count meets all bounds given."""
    out = F.lit(True)
    for bound, test in ((at_least, lambda v, b: v >= b), (at_most, lambda v, b: v <= b), (exactly, lambda v, b: v == b)):
        if bound is not None:
            out = out & test(value, bound)
    return out


def role_accuracy(expected: DataFrame, found: DataFrame, case: str, name: str, role: str) -> DataFrame:
    """Per case: expected names, those with the right role, missing and wrong ones, accuracy."""
    got = found.groupBy(case, name).agg(F.min(role).alias("__got"))
    joined = expected.join(got, [case, name], "left")
    return joined.groupBy(case).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("__got") == F.col(role)).alias("correct"),
        F.count_if(F.col("__got").isNull()).alias("missing"),
        F.count_if(F.col("__got") != F.col(role)).alias("wrong"),
    ).withColumn("accuracy", F.col("correct") / F.col("total"))


def band(share: Column) -> Column:
    """Colour of a pass rate."""
    return F.when(share >= 0.8, "green").when(share >= 0.5, "yellow").otherwise("red")


def run_summary(cases: DataFrame, run: list[str], passed: str) -> DataFrame:
    """Per run: passed, total, percentage, band."""
    out = cases.groupBy(*run).agg(F.count_if(F.col(passed)).alias("passed"), F.count("*").alias("total"))
    share = F.col("passed") / F.col("total")
    return out.withColumn("percent", F.bround(share * 100, 1)).withColumn("band", band(share))


def diff_last_two(cases: DataFrame, suite: str, ts: str, case: str, passed: str) -> DataFrame:
    """Per suite and case the last two runs side by side: ``=`` same, ``+`` now passes, ``-`` now fails, new, gone."""
    runs = cases.select(suite, ts).distinct().withColumn("n", F.row_number().over(Window.partitionBy(suite).orderBy(F.desc(ts)))).where("n <= 2")
    of = lambda n, c: cases.join(runs.where(F.col("n") == n), [suite, ts], "left_semi").select(suite, case, F.col(passed).alias(c))
    both = of(1, "now").join(of(2, "before"), [suite, case], "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("before"), "=").when(F.col("now"), "+").otherwise("-")
    return both.withColumn("change", change)
