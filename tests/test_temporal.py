import datetime

from pyspark.sql import functions as F

from plotweave.operators import temporal as P

D = datetime.date
SCENES = [("s1", "1940"), ("s2", "1943-05"), ("s3", "1943-05-17"), ("s4", "1943-05-20"), ("s5", "1944-02-30"), ("s6", None), ("s7", "soon"), ("s8", "1950"), ("s9", "1943")]


def scenes(spark):
    return spark.createDataFrame(SCENES, "scene_id STRING, date STRING")


def test_ranges_of_partial_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("1943", "1944-02", " 1943-05-17 ", "1944-02-30", "1943-13", "", "19", None, "1943-5-1")], "d STRING")
    out = [r.r for r in df.select(P.date_range(F.col("d")).alias("r")).collect()]
    assert [None if r is None else (r.low, r.high) for r in out] == [(D(1943, 1, 1), D(1943, 12, 31)), (D(1944, 2, 1), D(1944, 2, 29)), (D(1943, 5, 17),) * 2, None, None, None, None, None, None]


def test_present_after_death(spark):
    presence = spark.createDataFrame([("a", s, "participant") for s, _ in SCENES] + [("a", "s8", "mentioned"), ("b", "s8", "participant"), ("a", "s8", "participant")], "character_id STRING, scene_id STRING, role STRING")
    statuses = spark.createDataFrame([("a", "s3", "dead"), ("a", "s8", "dead"), ("b", "s6", "dead"), ("b", "s4", "ill")], "character_id STRING, scene_id STRING, status STRING")
    out = sorted(tuple(r) for r in P.present_after_death(presence, statuses, scenes(spark)).collect())
    assert out == [("a", "s3", "s2", False), ("a", "s3", "s4", True), ("a", "s3", "s8", True), ("a", "s3", "s9", False)]


def test_used_before_known(spark):
    uses = spark.createDataFrame([("a", "ring", s) for s, _ in SCENES] + [("b", "map", "s1"), ("b", "key", "s1")], "character_id STRING, thing_id STRING, scene_id STRING")
    known = spark.createDataFrame([("ring", "s4"), ("ring", "s8"), ("map", "s7")], "thing_id STRING, scene_id STRING")
    out = sorted(tuple(r) for r in P.used_before_known(uses, known, scenes(spark)).collect())
    assert out == [("a", "ring", "s1", "s4", True), ("a", "ring", "s2", "s4", False), ("a", "ring", "s3", "s4", True), ("a", "ring", "s9", "s4", False)]


def test_first_encounters_and_status(spark):
    presence = spark.createDataFrame([(c, s, "participant") for c in "ab" for s in ("s8", "s4", "s3")] + [("c", "s4", "participant"), ("c", "s1", "mentioned"), ("a", "s1", "participant")], "character_id STRING, scene_id STRING, role STRING")
    out = sorted(tuple(r) for r in P.first_encounters(presence, scenes(spark)).collect())
    assert out == [("a", "b", "s3", D(1943, 5, 17)), ("a", "c", "s4", D(1943, 5, 20)), ("b", "c", "s4", D(1943, 5, 20))]
    statuses = spark.createDataFrame([("a", "s1", "well"), ("a", "s3", "ill"), ("a", "s2", "dead")], "character_id STRING, scene_id STRING, status STRING")
    found = {(r.character_id, r.scene_id): (r.status, r.since) for r in P.status_as_of(presence, statuses, scenes(spark)).collect()}
    assert found[("a", "s1")] == (None, None) and found[("a", "s3")] == ("ill", "s3") and found[("a", "s8")] == ("dead", "s2") and found[("b", "s8")] == (None, None)


def test_empty(spark):
    presence = spark.createDataFrame([], "character_id STRING, scene_id STRING, role STRING")
    statuses = spark.createDataFrame([], "character_id STRING, scene_id STRING, status STRING")
    for df in (P.present_after_death(presence, statuses, scenes(spark)), P.first_encounters(presence, scenes(spark)), P.status_as_of(presence, statuses, scenes(spark))):
        assert df.count() == 0
