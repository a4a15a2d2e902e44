"""The registered queries over the training-data tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, exact_dedup, importance, language_id, lexical_index, license_scan, line_dedup, mixing, rotation_codes, simhash, suffix_pieces, toxicity, vector_search


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).drop("text_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.ints) = 0 THEN 0 ELSE CAST(list_dot_product(q.ints, c.ints) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.ints) = len(q.ints)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_runs(_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_documents(spark, sf_dir)).drop("text_sha256")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("text_sha256")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.token_digest(_documents(spark, sf_dir))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_paragraphs(_documents(spark, sf_dir))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licenses").alias("n_predicted"), F.size(sure).alias("n_confirmed"), families.alias("families"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.ranked_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


OP11_SQL = r"""
WITH RECURSIVE step(i, c, n) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM step WHERE n < 8
), crcs AS (SELECT list(c ORDER BY i) AS t FROM step WHERE n = 8),
lowered AS (
  SELECT 'd' AS side, row_number() OVER () AS pos, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (SELECT side, pos, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lowered),
counted AS (SELECT side, pos, w, count(*) AS n FROM words GROUP BY ALL),
signs AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1]))) % 10000 AS bucket FROM signs, crcs
), totals AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counted JOIN hashed USING (w) GROUP BY bucket
), sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM totals),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM totals, sums
), weights AS (
  SELECT pos, sum(n) AS n, sum(n * gain) AS weight FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY pos
), scored AS (
  SELECT pos, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM lowered LEFT JOIN weights USING (pos) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS enough FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * enough // 100 THEN place END AS rank FROM placed
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS pos, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), tf AS (SELECT pos, w, count(*) AS tf FROM (SELECT pos, unnest(words) AS w FROM docs) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
stats AS (SELECT count(*) AS nn, CAST(sum(len(words)) AS BIGINT) AS ll FROM docs WHERE len(words) > 0),
asked AS (
  SELECT item_id, w, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL
), weighed AS (SELECT item_id, w, times, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM asked JOIN df USING (w), stats),
scored AS (
  SELECT item_id, pos, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(words) * nn) // ll)))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (w) JOIN docs USING (pos), stats GROUP BY item_id, pos, doc_id
), ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS pos, vec_id, label, embedding, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), u AS (SELECT pos, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM v WHERE ok),
links AS (
  SELECT a.pos AS a, b.pos AS b FROM u a JOIN u b ON a.label = b.label AND a.pos <> b.pos AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS pos, min(v.vec_id) AS least FROM reach r JOIN v ON r.b = v.pos GROUP BY r.a),
n AS (SELECT a AS pos, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(least, vec_id), vec_id) AS component_id, coalesce(vec_id = least(coalesce(least, vec_id), vec_id), false) AS kept
FROM v LEFT JOIN n USING (pos) LEFT JOIN least USING (pos)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash_near_dedup": op1_simhash_near_dedup, "op2_toxicity": op2_toxicity, "op3_exact_top_k": op3_exact_top_k, "op4_line_dedup": op4_line_dedup, "op5_exact_dedup": op5_exact_dedup, "op6_language_id": op6_language_id, "op7_source_mix": op7_source_mix, "op8_sentencepiece": op8_sentencepiece, "op9_class_lm": op9_class_lm, "op10_license_scan": op10_license_scan, "op11_importance_resampling": op11_importance_resampling, "op12_lexical_search": op12_lexical_search, "op13_vector_near_dedup": op13_vector_near_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_vector_near_dedup": OP13_SQL}
