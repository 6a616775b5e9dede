"""Small tables with the awkward rows that every operator must handle."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = "The river ran past the old mill and the miller watched it every evening from his open window"


def documents(spark, texts, langs=None, sources=None, ids=None, extra=()):
    """A documents table; ``extra`` names columns that clash with what operators return."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = SCHEMA
    for name in extra:
        schema = T.StructType([*schema.fields, T.StructField(name, T.StringType())])
        rows = [(*r, "x") for r in rows]
    return spark.createDataFrame(rows, schema)


def awkward():
    """Nulls, empty and blank texts, repeats, case variants, one long text and characters outside ASCII."""
    return [PROSE, PROSE, PROSE.upper(), None, "", " \t\n", "a", "Straße İstanbul ñandú", "日本語 テキスト", "\u0000x y z", "one two", "😀 " * 50, (PROSE + " ") * 3000, PROSE + " again", None]
