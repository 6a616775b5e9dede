import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from plotweave.functions import registry, vectors
from plotweave.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t STRING").select(column(F.col("t")).alias("v")).first().v


def reference(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()


@pytest.mark.parametrize("name", ["Élodie  Ñandú", " Straße ", "ﬁne ﬂow", "Ǆ ½ ²", "İstanbul", "été", "Ｆｕｌｌ", "日本", " x ", "Ålesund Øst Ł", ""])
def test_normalize_is_the_rule(spark, name):
    assert one(spark, name, T.normalize) == reference(name)


@pytest.mark.parametrize(("name", "slug"), [("Ada  Brandt!", "ada-brandt"), ("--X--", "x"), ("Elysium-7", "elysium-7"), ("É", "e"), ("!!", "")])
def test_slugify(spark, name, slug):
    assert one(spark, name, T.slugify) == slug


@pytest.mark.parametrize(("text", "n"), [("", 0), ("  ", 0), ("a", 1), ("a b c", 4), ("a b\n c\td", 5)])
def test_estimate_tokens(spark, text, n):
    assert one(spark, text, T.estimate_tokens) == n == int(len(text.split()) * 1.35)


@pytest.mark.parametrize(("era", "date"), [("1940s", "1940-01-01"), ("late 1942", "1942-01-01"), ("the 40s", "unknown"), (None, "unknown"), ("19451946", "1945-01-01")])
def test_era_to_date(spark, era, date):
    assert one(spark, era, T.era_to_date) == date


def test_blank_blocks_excerpt_aliases(spark):
    assert one(spark, "  \n", T.null_if_blank) is None and one(spark, " x ", T.null_if_blank) == " x "
    assert one(spark, "a\r\n\r\n\r\nb\nc\n\n  \n\n", T.blocks) == ["a", "b\nc"]
    assert one(spark, "a\r\nb\n \nc", T.blocks) == ["a\nb", "c"] or one(spark, "a\r\nb\nc", T.blocks) == ["a", "b", "c"]
    assert one(spark, "no\n  Meet ADA here\nada", lambda t: T.excerpt(t, F.lit("Ada"))) == "Meet ADA here"
    assert one(spark, "ada" + "x" * 200, lambda t: T.excerpt(t, F.lit("Ada"))) == "ada" + "x" * 117 + "…"
    assert one(spark, "none", lambda t: T.excerpt(t, F.lit("Ada"))) is None
    assert one(spark, '["a","b"]', T.parse_aliases) == ["a", "b"] and one(spark, None, T.parse_aliases) == [] and one(spark, "oops", T.parse_aliases) == []


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n"), vectors.squared_distance(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert row.c == pytest.approx(0.5**0.5) and row.n == 0.0 and row.d == 1.0


def test_sql_functions(spark):
    registry.register(spark)
    row = spark.sql("SELECT normalize_name(' Éa ') a, slugify('É b') b, estimate_tokens('x y z') c, null_if_blank(' ') d, fuzz_ratio('ab', 'ac') e, wratio('voss', 'lena voss') f, coverage('voss', 'lena voss') g").first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("ea", "e-b", 4, None, 50.0) and row.f == pytest.approx(90) and row.g == pytest.approx(0.6364, abs=1e-4)
    assert [r.chunk for r in spark.sql("SELECT * FROM segment_text('a b', 10, 0.2D)").collect()] == ["a b"]


def test_sql_scores_equal_those_of_single_pairs(spark):
    from plotweave.functions import similarity

    registry.register(spark)
    names = ["", " ", "voss", "lena voss", "Lena  Voss of the Harbour", "karl", "karl anders", None]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a STRING, b STRING")
    for r in pairs.selectExpr("a", "b", "fuzz_ratio(a, b) f", "wratio(a, b) w", "coverage(a, b) c").collect():
        if r.a is None or r.b is None:
            assert (r.f, r.w, r.c) == (None, None, None)
        else:
            assert (r.f, r.w, r.c) == pytest.approx((similarity.ratio(r.a, r.b), similarity.weighted(r.a, r.b), similarity.coverage(r.a, r.b)))


def test_segment_table_and_embed(spark):
    from plotweave.operators import search, segment

    registry.register(spark)
    texts = [(i, t) for i, t in enumerate(["a b", "", None, "\n\n".join(f"block {i} " + "word " * 30 for i in range(40)), "one\ntwo"] * 3)]
    spark.createDataFrame(texts, "id INT, text STRING").repartition(4).createOrReplaceTempView("texts_in")
    want = sorted(tuple(r) for r in segment.segment_texts(spark.table("texts_in").withColumn("id", F.col("id").cast("string")), "id", "text", 100, 0.2).collect())
    for source in ("TABLE(SELECT id, text FROM texts_in)", "TABLE(SELECT id, text FROM texts_in) PARTITION BY (id)"):
        assert sorted(tuple(r) for r in spark.sql(f"SELECT * FROM segment_table({source}, 100, 0.2D)").collect()) == want
    assert spark.sql("SELECT * FROM segment_table(TABLE(SELECT id, text FROM texts_in WHERE id < 0), 100, 0.2D)").count() == 0
    rows = spark.table("texts_in").select(F.expr("embed(text)").alias("a"), search.embed(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_normalize_over_all_of_unicode(spark):
    """Characters whose lower case is newer than Python's tables aside."""
    known = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(known[i : i + 50]) for i in range(0, len(known), 50)] + ["Андрей Άλφα", "ΑΣ ΟΔΟΣ", "한국어 ㌀", "it's a\\b"]
    registry.register(spark)
    table = spark.createDataFrame([(t,) for t in texts], "t STRING")
    rows = table.select("t", T.normalize(F.col("t")).alias("a"), F.expr("normalize_name(t)").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a != reference(r.t) for r in rows) <= 6
    assert {r.t: r.a for r in rows}["Андрей Άλφα"] == "андреи αλφα"
