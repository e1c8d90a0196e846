"""The registered queries of the corpus operators; each is a thin digest of an operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_extract, language_id, lexical_search, packing, quality, resampling, sentencepiece_sampling, simhash, suffix_dedup, token_files, url_filter
from .common import stable_fold, table

#: Rules of op9: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = ann.nearest(rows, rows.where("vec_id % 100 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_counts(table(spark, sf_dir, "documents"))
    # Where a document lies in the files depends on how rows are dealt to tasks.
    return found.select(F.col("id").alias("doc_id"), "n_tokens")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_sentencepiece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_sampling.encode_samples(table(spark, sf_dir, "documents"))
    digest = found.select("id", "draw", "ids", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion")
    decoded = sentencepiece_sampling.decode_ids(digest, keep=("id", "draw", "n_pieces", "ids_hash", "log_prob", "log_inclusion"))
    return decoded.select(F.col("id").alias("doc_id"), "draw", "n_pieces", "ids_hash", "log_prob", "log_inclusion", F.xxhash64("text").alias("decoded_hash"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn_from = "pmod(crc32(cast(doc_id as string)), 3) <> 1"
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from)
    return found.select("doc_id", (stable_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select(found.id.alias("doc_id"), simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_filter.mine_rules(pages, table(spark, sf_dir, "labels"), "page_id", "doc_id")
    return url_filter.judge_urls(pages, mined, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = stable_fold("doc_id", 4)
    model = language_id.train(docs.where(fold != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw_neighbours": op1_hnsw_neighbours,
    "op2_token_counts": op2_token_counts,
    "op3_html_main_text": op3_html_main_text,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_sentencepiece_samples": op5_sentencepiece_samples,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_quality_scores": op7_quality_scores,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_language_id": op10_language_id,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    # The given pages have one article each, and only a few kinds of tags and references inside it.
    "op3_html_main_text": r"""SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|br|h1|h2|h3|ul|li|div)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages)""",
    # Every 100-byte window of every text, ranked among its equals; the runs that later ones cover are cut.
    "op4_suffix_array_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, CAST(octet_length(b) AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, b[i:i + 99] AS k FROM (SELECT doc_id, b, unnest(generate_series(1, n - 99)) AS i FROM n WHERE n >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS f FROM r)),
s AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS f, s AS t FROM s UNION ALL SELECT n.doc_id, coalesce(x.e, 1), n.n + 1 FROM n LEFT JOIN (SELECT doc_id, max(e) AS e FROM s GROUP BY 1) x ON n.doc_id = x.doc_id),
h AS (SELECT c.doc_id, coalesce(string_agg(hex(b[f:t - 1]), '' ORDER BY f), '') AS h FROM c JOIN n ON c.doc_id = n.doc_id WHERE t > f GROUP BY 1)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(q.removed, 0) AS BIGINT) AS n_removed, coalesce(q.spans, 0) AS n_spans, sha256(unhex(coalesce(h.h, ''))) AS kept_sha256
FROM n LEFT JOIN (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM s GROUP BY 1) q ON n.doc_id = q.doc_id LEFT JOIN h ON n.doc_id = h.doc_id""",
}
