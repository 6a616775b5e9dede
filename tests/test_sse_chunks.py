import random

from pyspark.sql import functions as F

from plotweave.sources import files

SCHEMA = "k STRING, n INT, chunk STRING, last BOOLEAN"


def test_any_cut_gives_the_messages_of_the_whole_body(spark, tmp_path):
    rng = random.Random(7)
    pieces = ["event: a", "data: 1", "data:two", "data:  three", ": note", "data", "id: 3", "event:b", "", ""]
    bodies = {f"k{i}": "".join(rng.choice(pieces) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 30))) + rng.choice(["", "data: end"]) for i in range(60)}
    want = sorted(tuple(r) for r in files.parse_sse(spark.createDataFrame(list(bodies.items()), "k STRING, body STRING"), "k", "body").collect())
    rows = []
    for k, body in bodies.items():
        cuts = sorted(rng.choices(range(len(body) + 1), k=rng.randint(0, 12)))
        parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)]
        rows += [(k, n, p or None, n == len(parts) - 1) for n, p in enumerate(parts)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in files.parse_sse_chunks(table.union(table.limit(20)), "k", "n", "chunk").collect()) == want
    # as a stream: out of turn, over three batches, some chunks twice
    rng.shuffle(rows)
    batches = [rows[:200], rows[200:350] + rows[:50], rows[350:] + rows[100:300]]
    query = None
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = files.parse_sse_chunks(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "n", "chunk", "last")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == want
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("k", "pos").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
