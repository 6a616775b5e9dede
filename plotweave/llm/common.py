"""Shared plumbing: table access, the folder all executors see, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set, by whatever store Spark reads ``sf_dir`` from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on a local master) a temporary folder is set; on a cluster that is an error,
    since a machine's own folder is not seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plotweave-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage, so a lost executor costs one stage and not the job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plotweave/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, **options) -> None:
        """Write ``df``; the shuffle files of that job go with its end, since nothing reads them again."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            writer = df.write.mode("overwrite").options(**{"compression": "zstd", **options})
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        finally:
            conf.set(key, before) if before is not None else conf.unset(key)

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` and read it back."""
        self.write(df, name, **options)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, through Spark's own file system layer."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Rows of one key that one task joins, and keys with more of them, at most.
HOT_ROWS, MOST_HOT = 1 << 14, 100_000


def join_hot(rows: DataFrame, by: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``by``, whose ``key`` is unique and whose ``n`` counts the rows that have it.

    Keys with more than ``HOT_ROWS`` rows (or ``total`` / MOST_HOT, so there are at most MOST_HOT of them to broadcast) are
    dealt to several tasks.
    """
    most = max(HOT_ROWS, total // MOST_HOT)
    hot = F.broadcast(by.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("__salts")))
    left = rows.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    right = by.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.when(F.col("n") > most, F.ceil(F.col("n") / most)).otherwise(1)).cast("int") - 1)))
    return left.join(right, [key, "__salt"], how).drop("__salt")
