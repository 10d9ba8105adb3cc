"""The subpackage's queries: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rate_quality

    return rate_quality(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import spans_text, substring_report

    return substring_report(documents(spark, sf_dir), runs=True).withColumn("spans", spans_text())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import counted_sample

    return counted_sample(documents(spark, sf_dir), vocabulary())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_dp import encode_decode

    return encode_decode(documents(spark, sf_dir), vocabulary())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_conversations

    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import detect_runs

    return detect_runs(documents(spark, sf_dir), damage=True)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_embeddings

    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


EXACT_SQL = """
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(max(doc_id) OVER g AS BIGINT) AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)"""

#: Every pair in SQL: right for the small tables it is compared on.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.ok AND y.ok AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(least(v.vec_id, coalesce(c.low, v.vec_id)) AS BIGINT) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the tests hold the others against brute force."""
    from .licenses import licenses_sql
    from .substring_dedup import report_sql

    return {"op1_license_scan": licenses_sql(), "op3_substring_dedup": report_sql(), "op4_exact_dedup": EXACT_SQL, "op13_embedding_dedup": EMBEDDING_SQL}
