"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import centroids, chat_format, conversation_repair, decontaminate, exact_dedup, language_id, lm_scoring, sharding, simhash_dedup, source_mixing, substring_dedup, token_binary, token_counts
from plotweave.llm.common import Scratch, crc_mod, read_table

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Place of a public tokenizer's file on this machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


OP2_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(10, len(words)) AS k FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM sized)),
spots AS (
  SELECT doc_id, k, i, array_to_string(words[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM cut, (SELECT DISTINCT k FROM windows) WHERE len(words) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM spots JOIN windows USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(read_table(spark, sf_dir, "documents"), shards=40, seed=1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(read_table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM normal GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM normal JOIN grouped USING (text_sha256)
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(more), tokenizer_path()))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 26 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars FROM turns),
said AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) + 13 AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""


#: Domain of a labelled document.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'plain' END"
#: Wanted shares of the domains' tokens.
WEIGHTS = {"good": 0.8, "plain": 0.15, "toxic": 0.05}


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, mixed = source_mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.expr(DOMAIN), WEIGHTS, seed=6)
    shares = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(fitted.classifier.domains)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    return lm_scoring.score_corpus(docs, ~F.col("held_out"), also=("held_out",))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-binary").path("shards")
    token_binary.materialise(read_table(spark, sf_dir, "documents"), tokenizer_path(), path, length=512, shard_rows=4096, key=1)
    return token_binary.sequences(token_binary.read_blocks(spark, path)).withColumnRenamed("id", "doc_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=10)
    names = F.sort_array(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


#: CRC-32 by its table, damage, faults, then the cheapest way to each state row by row; min compares (cost, letters).
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
marked AS (SELECT * EXCLUDE (bytes), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM named, crc),
damaged AS (
  SELECT key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY key) AS size FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY n) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
-- states: 0 none, 1 system, 2 user, 3 assistant; inserts before an edit: from, to, letters, cost, rows
inserts(a, b, li, ci, ri) AS (VALUES
  (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']), (3, 2, 'I', 3, ['user:']),
  (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:']), (2, 2, 'II', 6, ['assistant:', 'user:']), (3, 3, 'II', 6, ['user:', 'assistant:'])),
kept(b, initial, c) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT key, n, a, b AS c, li || 'D' AS letters, ci + 4 AS cost, ri AS said FROM judged, inserts
  UNION ALL
  SELECT key, n, a, c, li || 'K', ci + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, list_append(ri, role || ':' || text) FROM judged, inserts JOIN kept USING (b) WHERE fault IN ('', 'truncated') AND kept.initial = judged.initial
  UNION ALL
  SELECT key, n, a, CASE b WHEN 2 THEN 3 ELSE 2 END, li || 'R', ci + 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, list_append(ri, CASE b WHEN 2 THEN 'assistant:' ELSE 'user:' END || text) FROM judged, inserts WHERE fault IN ('', 'truncated')),
walk AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': 0, 'letters': '', 'said': CAST([] AS VARCHAR[])} AS best FROM judged
  UNION ALL
  SELECT key, edits.n, c, min({'cost': best.cost + edits.cost, 'letters': best.letters || edits.letters, 'said': list_concat(best.said, edits.said)}) FROM walk JOIN edits USING (key) WHERE edits.n = walk.n + 1 AND a = state GROUP BY key, edits.n, c),
ended AS (
  SELECT key, min({'cost': best.cost + ci, 'letters': best.letters || li, 'said': list_concat(best.said, ri)}) AS best
  FROM walk JOIN (SELECT key, max(n) AS n FROM judged GROUP BY key) USING (key, n) JOIN inserts ON a = state WHERE b IN (0, 3) GROUP BY key),
counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY key)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.letters, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM named) LEFT JOIN counted USING (key) LEFT JOIN ended USING (key)
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), width=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH cut AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc, i, array_to_string(words[i : i + 19], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM cut)),
again AS (SELECT doc, i FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc, i) > 1),
gone AS (SELECT DISTINCT doc, unnest(range(i, i + 20)) AS w FROM again),
stay AS (
  SELECT doc, count(*) AS n, string_agg(word, ' ' ORDER BY w) AS kept
  FROM (SELECT doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS w FROM cut) ANTI JOIN gone USING (doc, w) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN stay USING (doc)
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Rounds as a chain of common table expressions; integer division rounds down."""
    out = [
        f"""vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q AS m FROM vectors QUALIFY c < {k})""",
    ]
    gap = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))"
    for n in range(rounds + 1):
        out.append(f"a{n} AS (SELECT vec_id, q, min({{'d': d, 'c': c}}) AS best FROM (SELECT row, vec_id, q, c, {gap} AS d FROM (SELECT row_number() OVER () AS row, * FROM vectors), c{n}) GROUP BY row, vec_id, q)")
        if n < rounds:
            out.append(f"s{n} AS (SELECT best.c AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY best.c, i)")
            out.append(f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{n} GROUP BY c)")
            out.append(f"c{n + 1} AS (SELECT c, coalesce(m{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN m{n} USING (c))")
    return (
        "WITH " + ",\n".join(out) + f"""
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c"""
    )


OP13_SQL = _op13_sql()

OPERATORS = (
    op1_token_binary, op2_decontaminate, op3_sharding, op4_exact_dedup, op5_chat_format,
    op6_source_mixing, op7_lm_scoring, op8_token_counts, op9_language_id, op10_simhash_dedup,
    op11_conversation_repair, op12_substring_dedup, op13_centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_chat_format": OP5_SQL, "op11_conversation_repair": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_centroids": OP13_SQL}
