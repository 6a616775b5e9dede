"""Scalar text functions and segmentation (families J and M) over the analogue tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotweave.functions import text as T
from plotweave.operators import segment as S
from plotweave.plans.lookups import _story
from plotweave.plans.story import SQL

WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
BLOCKS = "list_filter(list_transform(string_split(text, chr(10)), lambda b: trim(b)), lambda b: b <> '')"

_docs = lambda s: s.table("documents").select("doc_id", "text")
_lines = lambda s: S.block_rows(_docs(s), "doc_id", "text")


def _vectors(s):
    return s.table("embeddings").select("label", "vec_id", "embedding")


PLANS = {
    "normalize_name": (_story(lambda s: s.table("documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))), "SELECT doc_id, trim(lower(strip_accents(text)), ' ' || chr(9) || chr(10) || chr(13)) AS norm FROM documents"),
    "slugify": (_story(lambda s: s.table("part").select("p_partkey", T.slugify(F.concat(F.lit("Él "), "p_name", F.lit("! "), "p_brand")).alias("slug"))), "SELECT p_partkey, trim(regexp_replace(lower('el ' || p_name || '! ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"),
    "estimate_tokens": (_story(lambda s: _docs(s).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))), f"SELECT doc_id, CAST(floor(len({WORDS}) * CAST(1.35 AS DOUBLE)) AS INTEGER) AS tokens FROM documents"),
    "null_if_blank": (_story(lambda s: s.table("customer").select("c_custkey", T.null_if_blank(F.when(F.col("c_custkey") % 3 == 0, " \t").otherwise(F.col("c_name"))).alias("v"))), "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS v FROM customer"),
    "era_to_date": (_story(lambda s: s.characters().select("id", T.era_to_date(F.col("era")).alias("date"))), SQL + "SELECT id, CASE WHEN era IS NULL THEN 'unknown' ELSE era[1:4] || '-01-01' END AS date FROM characters"),
    "excerpt": (_story(lambda s: s.chunks().select("id", T.excerpt(F.col("text"), F.lit("the and")).alias("line"))), SQL + ", f AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the and'))[1] AS l FROM chunks) SELECT id, CASE WHEN length(trim(l)) > 120 THEN trim(l)[1:120] || '…' ELSE trim(l) END AS line FROM f"),
    "scene_ids": (_story(lambda s: s.chunks().select("stem", "idx", T.scene_id(F.col("stem").cast("string"), F.col("idx"), F.count("*").over(Window.partitionBy("stem"))).alias("scene_id"))), SQL + "SELECT stem, idx, CASE WHEN count(*) OVER (PARTITION BY stem) = 1 THEN 'scene-' || stem ELSE 'scene-' || stem || '-chunk-' || lpad(CAST(idx AS VARCHAR), 2, '0') END AS scene_id FROM chunks"),
    "segment_blocks": (_story(_lines), f"SELECT doc_id AS id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos, unnest(b) AS block FROM (SELECT doc_id, {BLOCKS} AS b FROM documents)"),
    "adjacent_cosine": (
        _story(lambda s: S.adjacent_similarity(_vectors(s), "label", "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))),
        "SELECT vec_id, round(list_cosine_similarity(e, lead(e) OVER (PARTITION BY label ORDER BY vec_id)), 6) AS similarity FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    ),
    "segment_group": (
        _story(lambda s: S.group_at_breaks(S.adjacent_similarity(_vectors(s), "label", "vec_id", "embedding"), "label", "vec_id", "similarity").select("vec_id", "grp")),
        "SELECT vec_id, CAST(coalesce(sum(CASE WHEN c < 0.45 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grp FROM (SELECT vec_id, label, list_cosine_similarity(e, lead(e) OVER (PARTITION BY label ORDER BY vec_id)) AS c FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))",
    ),
    "segment_overlap": (
        _story(lambda s: S.overlap_tail(s.chunks(), "stem", "idx", "text", 5).select("id", "overlapped")),
        SQL + f", w AS (SELECT id, text, lag({WORDS}) OVER (PARTITION BY stem ORDER BY idx) AS p FROM chunks) SELECT id, CASE WHEN p IS NULL THEN text ELSE array_to_string(p[greatest(len(p) - 4, 1):], ' ') || chr(10) || chr(10) || text END AS overlapped FROM w",
    ),
    "segment_documents": (_story(lambda s: S.segment_texts(_docs(s), "doc_id", "text")), None),
    "next_chunk_links": (_story(lambda s: S.next_chunks(s.chunks(), "stem", "idx", "id")), SQL + "SELECT * FROM (SELECT id AS from_id, lead(id) OVER (PARTITION BY stem ORDER BY idx) AS to_id FROM chunks) WHERE to_id IS NOT NULL"),
}
