"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and
reads it back as the next stage's input. All but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and further columns of any
name; its docstring says what becomes of a null or empty text. Rows that repeat an id are told apart by their texts, rows
without an id stay where an id would decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import decontaminate, language_id, queries, sharding, simhash_dedup, source_mixing
from plotweave.llm.common import Scratch, read_table

#: Least share of a text's letters in its main language.
LEAST_SHARE = 0.5
#: Factors on the tokens of the labelled domains: toxic text goes, the rest keeps its proportions.
MIX = {"good": 1.0, "plain": 1.0, "toxic": 0.0}
#: Rates this near to a whole number are taken as it: text that is surely not toxic stays exactly once.
SNAP = 0.25
#: How much rates keep to 1: with less, text that is a little likely to be toxic would make room for other text.
RIDGE = 1e-3
SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose main language has less than half of the letters, go."""
    return language_id.keep_identified(docs, language_id.train(docs), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Null and wordless texts are copies of each other. Rows that repeat the kept id stay, rows without an id too.
    """
    return simhash_dedup.drop_near_duplicates(docs, find=simhash_dedup.similar_documents, width=5, least=0.8)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go; null and empty texts have none and stay."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix says; null and empty texts have the posterior of an empty text."""
    labels = read_table(spark, sf_dir, "labels")
    return source_mixing.repeat_rows(docs, labels, F.expr(queries.DOMAIN), MIX, relative=True, snap=SNAP, ridge=RIDGE)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with the size, the shard and the slot in it; a column that is named like one of these gets ``_in`` behind it.

    Every row gets a place; a null text has the size 16.
    """
    return sharding.interleave(docs, SHARDS, seed=1, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_domains),
    ("sharding", assign_shards),
]

#: SQL can express neither the learned stages nor the shingles; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs
