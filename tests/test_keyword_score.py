"""The keyword score of long texts, against the rule in Python, and its time by the number of keywords."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from plotweave.functions import text as T
from plotweave.operators import metrics

ODD = "½ﬁ…㎏①Ǆ가각힣ΣΑΣİßÉñÁ  ｶﾞ𝔘🇦"


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()


def score(spark, texts, keywords):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING")
    return [r.s for r in df.select("id", metrics.keyword_score(F.col("t"), F.array(*[F.lit(k) for k in keywords])).alias("s")).orderBy("id").collect()]


def test_against_the_rule(spark):
    texts = ["", " ", "plain ASCII only", ODD, f"\n {ODD * 3} tail ", "Á" * 50 + "ñ", *[a + "x" + b for a, b in zip(ODD, ODD[1:], strict=False)]]
    keywords = ["1⁄2", "FI...kg", " Été ", "", "각", "ss", "ax", "tail ", "ascii"]
    found = score(spark, texts, keywords)
    assert found == pytest.approx([sum(plain(k).strip() in plain(t) for k in keywords) / len(keywords) for t in texts])
    assert score(spark, [None], ["a", "b"]) == [0.0]
    for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", T.plain(F.col("t")).alias("p"), T.normalize(F.col("t")).alias("n")).collect():
        assert (r.p, r.n) == (plain(r.t), plain(r.t).strip())


def test_a_text_is_made_plain_once(spark):
    """Before, the rule ran over the whole text for each keyword."""
    texts = ["Élan… vital ½ " * 4000] * 20

    def seconds(keywords):
        score(spark, texts[:1], keywords)
        began = time.perf_counter()
        score(spark, texts, keywords)
        return time.perf_counter() - began

    one = seconds(["zz0"])
    assert seconds([f"zz{i}" for i in range(16)]) < 4 * one + 1
