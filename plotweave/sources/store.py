"""Story tables as versioned Parquet folders with one manifest.

A table is one folder, or one for each bucket of its scenes' files (``schemas.BUCKETED``). A write goes to a new folder;
a manifest names the folders of all tables, and a change of several tables becomes visible with its manifest, so readers
see all of it or nothing, and what fails halfway leaves the store as it was. A load rewrites the buckets that it touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.sources import schemas

WHOLE = "-"


class Busy(RuntimeError):
    """Another import holds the store, or another writer has changed it meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: tuple[int, dict] = (-1, {})
        self._staged: dict | None = None

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._path("_manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName()[:-5].isdigit()) if fs.exists(path) else []

    def _manifest(self, number: int) -> dict:
        path, fs = self._path(f"_manifests/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self) -> tuple[int, dict]:
        """Number of the newest manifest and, by table and bucket, its folders."""
        numbers = self._manifests()
        if numbers and self._known[0] != numbers[-1]:
            self._known = numbers[-1], self._manifest(numbers[-1])
        return self._known if numbers else (0, {})

    def _create(self, name: str, text: str) -> bool:
        """Write a small file unless it exists."""
        path, fs = self._path(name)
        if fs.exists(path):
            return False
        partial, _ = self._path(f"{name}.{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}")
        out = fs.create(partial, False)
        out.writeBytes(text)
        out.close()
        if fs.exists(path) or not fs.rename(partial, path):
            fs.delete(partial, False)
            return False
        return True

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All writes inside become visible together; reads inside see them already."""
        if self._staged is not None:
            yield
            return
        number, tables = self._state()
        self._staged = {t: dict(b) for t, b in tables.items()}
        try:
            yield
            if self._staged != tables and not self._create(f"_manifests/{number + 1:012d}.json", json.dumps(self._staged)):
                raise Busy("the store has changed since this transaction began")
        finally:
            self._staged = None

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One import at a time; a second one is refused. ``unlock`` frees a store whose import has died."""
        if not self._create("_import.lock", "held"):
            raise Busy("an import is running")
        try:
            yield
        finally:
            self.unlock()

    def unlock(self) -> None:
        path, fs = self._path("_import.lock")
        fs.delete(path, False)

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or of a bucketed one some buckets; empty where nothing has been written."""
        held = (self._staged if self._staged is not None else self._state()[1]).get(table, {})
        wanted = held if buckets is None else {b: held[b] for b in (WHOLE, *map(str, buckets)) if b in held}
        if not wanted:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        out = self.spark.read.schema(schemas.TABLES[table]).parquet(*(f"{self.root}/{folder}" for folder in wanted.values()))
        if WHOLE in wanted and buckets is not None:
            out = out.where(self.bucket_of(table).isin(*buckets))
        return out

    @staticmethod
    def bucket_of(table: str) -> Column:
        """The bucket of a row of a bucketed table: that of the file its scene is from."""
        return schemas.bucket(schemas.stem_of(F.col(schemas.BUCKETED[table])))

    def write(self, table: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """Replace the table, or of a bucketed one the given buckets (``df`` holds rows of those only)."""
        with self.transaction():
            columns = [f.split(" ")[0] for f in schemas.TABLES[table].split(", ")]
            folder = f"{table}/{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
            if table not in schemas.BUCKETED:
                df.select(*columns).write.parquet(f"{self.root}/{folder}")
                self._staged[table] = {WHOLE: folder}
                return
            df.select(*columns, self.bucket_of(table).alias("__bucket")).write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
            held = {} if buckets is None else dict(self._staged.get(table, {}))
            for b in range(schemas.BUCKETS) if buckets is None else buckets:
                path, fs = self._path(f"{folder}/__bucket={b}")
                held.pop(str(b), None)
                if fs.exists(path):
                    held[str(b)] = f"{folder}/__bucket={b}"
            self._staged[table] = held

    def append_events(self, events: DataFrame) -> None:
        """Add progress events; they show at once, for whoever follows the import."""
        events.write.mode("append").json(f"{self.root}/_events")

    def events(self, stream: bool = False) -> DataFrame:
        reader = (self.spark.readStream if stream else self.spark.read).schema(schemas.EVENTS)
        path, fs = self._path("_events")
        fs.mkdirs(path)
        return reader.json(f"{self.root}/_events")

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest manifests names, and older manifests; gives the number of folders."""
        numbers = self._manifests()
        named = {f.split("/__bucket=")[0] for n in numbers[-keep:] for t in self._manifest(n).values() for f in t.values()}
        gone = 0
        for table in schemas.TABLES:
            path, fs = self._path(table)
            for found in fs.listStatus(path) if fs.exists(path) else []:
                if f"{table}/{found.getPath().getName()}" not in named:
                    fs.delete(found.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            path, fs = self._path(f"_manifests/{n:012d}.json")
            fs.delete(path, False)
        return gone

    def wipe(self) -> None:
        """Make every table empty."""
        with self.transaction():
            self._staged.clear()

    def views(self) -> None:
        """Register every table as a temporary view of its name."""
        for table in schemas.TABLES:
            self.read(table).createOrReplaceTempView(table)
