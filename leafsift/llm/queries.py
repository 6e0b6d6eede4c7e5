"""The operators of this package over the given tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.llm.common import table
from leafsift.llm.decontamination import benchmark_matches, hit_words
from leafsift.llm.hard_negatives import hard_negatives
from leafsift.llm.html_text import main_text
from leafsift.llm.language_id import identify_languages
from leafsift.llm.lexical import rank_documents
from leafsift.llm.line_dedup import without_common_lines
from leafsift.llm.packing import pack_documents
from leafsift.llm.pii import find_personal_data, written
from leafsift.llm.sharding import shard_by_bytes
from leafsift.llm.simhash import hex_fingerprint, near_duplicates
from leafsift.llm.substrings import without_repeated_windows
from leafsift.llm.suffix_tree import score_documents
from leafsift.llm.topk import top_k


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.concat("base", "added")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_hit = hit_words(F.col("hits"))
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2).select(
        "doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify_languages(docs).select(
        "doc_id", F.col("lang").alias("declared"), "language", "probability", "text_language", "rejected")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_windows(table(spark, sf_dir, "documents"), window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, negatives=3)


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_sharding, op3_personal_data, op4_decontamination, op5_suffix_tree, op6_simhash, op7_line_dedup, op8_packing, op9_topk,
    op10_language_id, op11_substring_dedup, op12_lexical_search, op13_hard_negatives)}

WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Everything but the ASCII characters that part terms.
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE = {
    "op9_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, pos, line, {LOWER_SQL.format(f"trim(line, {WHITE_SQL})")} AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
per AS (SELECT k.r, count(*) AS n_lines, count(c.key) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '') AS kept
        FROM k LEFT JOIN common c ON c.key = k.key GROUP BY k.r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM per JOIN d USING (r)""",
    "op11_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+') AS ws FROM documents),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word, ws FROM w),
k AS (SELECT doc_id, pos, CASE WHEN pos + 19 <= len(ws) THEN array_to_string(ws[pos : pos + 19], ' ') END AS win FROM p),
r AS (SELECT doc_id, pos, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM k),
c AS (SELECT doc_id, pos, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
             string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c JOIN p USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)""",
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '{TERM_SQL}') AS ts FROM documents),
tot AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS total FROM d),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf
      FROM (SELECT item_id, unnest(regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '{TERM_SQL}')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, term, qtf * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN df USING (term), tot),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM w JOIN tfs USING (term), tot GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
