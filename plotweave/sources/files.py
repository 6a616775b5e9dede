"""Text folders, run history, server-sent events and the export."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from plotweave.sources import schemas

# File name endings of scene texts.
EXTENSIONS = ("txt", "md", "fountain", "text", "rst", "log")


def _named(df: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    return df.select(name.alias("filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text")).where(F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)).isin(*EXTENSIONS))


def read_scene_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, stem, text``: one row per text file of the folder, by name, endings compared without case."""
    return _named(spark.read.text(folder, wholetext=True).withColumn("path", F.url_decode(F.input_file_name()))).orderBy("filename")


class NoScenes(ValueError):
    """An upload without a text file."""


def accept(files: DataFrame) -> DataFrame:
    """The files of an upload with a known ending; an error if there is none."""
    kept = files.where(F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)).isin(*EXTENSIONS))
    if kept.isEmpty():
        raise NoScenes(f"no file with one of the endings {', '.join(EXTENSIONS)}")
    return kept


def stream_scene_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of files that arrive in the folder."""
    return _named(spark.readStream.text(folder, wholetext=True).withColumn("path", F.url_decode(F.input_file_name())))


def append_history(runs: DataFrame, path: str) -> None:
    """Append runs as JSON lines."""
    runs.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, suite: str | None = None) -> DataFrame:
    """Runs of a suite; malformed lines are skipped, fields that a line lacks are null."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    runs = lines.select(F.from_json("value", schemas.HISTORY).alias("r")).select("r.*")
    return runs if suite is None else runs.where(F.col("suite") == suite)


def malformed_history(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not JSON."""
    return spark.read.text(path).where(F.try_parse_json("value").isNull())


def parse_sse(text: DataFrame, key: str, value: str) -> DataFrame:
    """``key, pos, event, data``: the messages of a server-sent event stream held in one text per row.

    Messages end at blank lines; CR LF counts as a line end; several data lines join with line ends; the last message
    needs no blank line; messages without data are dropped; the event is ``message`` where none is named.
    """
    unix = F.regexp_replace(F.col(value), "\r\n?", "\n")
    messages = text.select(key, F.posexplode(F.split(unix, "\n\n+")).alias("pos", "raw")).withColumn("lines", F.split("raw", "\n"))
    of = lambda field: F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(f"{field}:"))), lambda x: F.regexp_replace(F.substring(x, F.lit(len(field) + 2), F.length(x)), "^ ", ""))
    found = messages.select(key, "pos", F.coalesce(F.get(of("event"), F.lit(0)), F.lit("message")).alias("event"), of("data").alias("d"))
    return found.where(F.size("d") > 0).select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("pos"), "event", F.array_join("d", "\n").alias("data"))


def parse_sse_chunks(chunks: DataFrame, key: str, order: str, chunk: str, last: str | None = None) -> DataFrame:
    """The messages of event streams that arrive in chunks, cut anywhere: what ``parse_sse`` gives for the whole text.

    ``order`` counts the chunks of a stream from 0. On a table, chunks are joined. On a stream of chunks, half-received lines and
    messages wait in the state of their ``key``, as do chunks that are ahead of their turn; a chunk that comes again is left
    out. ``last`` names a boolean column that marks the final chunk, which ends the last message; without it a
    message is given when its blank line is there. A null chunk is empty. An ended stream leaves a number in the state, so repeats of it stay out.
    """
    if not chunks.isStreaming:
        first = chunks.groupBy(key, order).agg(F.min(F.coalesce(chunk, F.lit(""))).alias("chunk"))
        parts = F.array_sort(F.collect_list(F.struct(order, "chunk")))
        return parse_sse(first.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("body")), key, "body")
    kind = chunks.schema[key].dataType.simpleString()

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, pos, rest, ahead = state.get if state.exists else (0, 0, "", "{}")
        waiting = {int(n): x for n, x in json.loads(ahead).items()}
        for frame in frames:
            for n, text, end in zip(frame["n"], frame["chunk"], frame["last"], strict=True):
                if n >= turn:
                    waiting.setdefault(int(n), (text or "", bool(end)))
        ended = False
        while turn in waiting and not ended:
            text, ended = waiting.pop(turn)
            rest, turn = rest + text, turn + 1
        # a carriage return at the end may be half of a line end
        held = "\r" if rest.endswith("\r") and not ended else ""
        text = re.sub("\r\n?", "\n", rest[: len(rest) - len(held)])
        whole, gap, tail = (text, "", "") if ended else text.rpartition("\n\n")
        found = []
        for message in re.split("\n\n+", whole):
            lines = [line.partition(":") for line in message.split("\n")]
            data = [value.removeprefix(" ") for name, colon, value in lines if colon and name == "data"]
            if data:
                pos += 1
                found.append((of[0], pos, next((v.removeprefix(" ") for name, colon, v in lines if colon and name == "event"), "message"), "\n".join(data)))
        if found:
            yield pd.DataFrame(found, columns=[key, "pos", "event", "data"])
        if ended:  # what comes again later is not taken for a new stream
            turn, tail, held, waiting = 1 << 62, "", "", {}
        state.update((turn, pos, tail + held, json.dumps(waiting)))

    end = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    source = chunks.select(key, F.col(order).cast("long").alias("n"), F.col(chunk).alias("chunk"), end.alias("last"))
    return source.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, pos INT, event STRING, data STRING", "turn LONG, pos INT, rest STRING, ahead STRING", "append", "NoTimeout")


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table as a folder of JSON lines under ``path``, nulls included; nothing is gathered in one place."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def export_document(tables: dict[str, DataFrame], path: str) -> None:
    """Write one JSON document: ``exported_at`` (UTC), and an array of rows for each table.

    It is the text of the part files in the order of their names (as ``getmerge`` or ``cat`` joins them), so all tasks write it. A row
    that JSON has no form for in a column is written with the column's text; nulls are kept. Rows stand in the order of their JSON.
    """
    spark = next(iter(tables.values())).sparkSession
    now = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t")).first().t
    out = spark.createDataFrame([(-1, 0, "", f'{{"exported_at": "{now}"'), (len(tables), 0, "", "}")], "at INT, part INT, row STRING, value STRING")
    for n, (name, df) in enumerate(tables.items()):
        row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("row")
        counted = df.select(row).groupBy("row").agg(F.count("*").alias("n"))
        first = F.broadcast(counted.agg(F.min("row").alias("first")))  # one row
        # the first row goes with the head, all others have a comma before them
        left = counted.join(first).withColumn("n", F.col("n") - F.when(F.col("row") == F.col("first"), 1).otherwise(0)).where("n > 0")
        rows = left.select(F.lit(n).alias("at"), F.lit(1).alias("part"), "row", F.concat(F.lit(", "), "row").alias("value"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
        head = first.select(F.lit(n).alias("at"), F.lit(0).alias("part"), F.lit("").alias("row"), F.concat(F.lit(f", {json.dumps(name)}: ["), F.coalesce("first", F.lit(""))).alias("value"))
        foot = spark.createDataFrame([(n, 2, "", "]")], "at INT, part INT, row STRING, value STRING")
        out = out.unionByName(head).unionByName(rows).unionByName(foot)
    order = ("at", "part", "row")
    out.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def to_sse(events: DataFrame, event: str = "event") -> DataFrame:
    """Events as messages of a server-sent event stream: ``sse``, with the other columns (nulls left out) as its data."""
    rest = [c for c in events.columns if c != event]
    return events.select("*", F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.to_json(F.struct(*rest)), F.lit("\n\n")).alias("sse"))


def write_sse(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Follow a stream of events and append their messages to text files, a poll a second."""

    def put(batch: DataFrame, _: int) -> None:
        to_sse(batch).select(F.expr("left(sse, length(sse) - 1)").alias("value")).write.mode("append").text(path)  # the writer ends the line

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def markdown_reports(results: DataFrame) -> DataFrame:
    """``case_name, report``: a Markdown report of each case (suite, case_name, passed, score, duration_s, detail)."""
    mark = F.when(F.col("passed"), "passed").otherwise("failed")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# "), "case_name"), F.lit(""), F.concat(F.lit("- suite: "), "suite"), F.concat(F.lit("- result: "), mark),
        F.concat(F.lit("- score: "), F.format_string("%.2f", F.coalesce("score", F.lit(0.0)))), F.concat(F.lit("- seconds: "), F.format_string("%.1f", F.coalesce("duration_s", F.lit(0.0)))), F.lit(""), F.coalesce("detail", F.lit("")),
    )
    return results.select("case_name", lines.alias("report"))
