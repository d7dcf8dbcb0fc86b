"""The thin queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` maps a name to a callable (spark, sf_dir) -> DataFrame, ``SQL``
maps a name to the same result in DuckDB's SQL where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import (
    bpe,
    fingerprints,
    media,
    ngram_join,
    packing,
    pii,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_rules,
)

#: The rules that op5 applies: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.encode_media(_table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(_table(spark, sf_dir, "documents"), size=4, percent=85).drop("k", "label")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, RULES))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_earlier(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media": op1_media,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii": op4_pii,
    "op5_url_rules": op5_url_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_fingerprints": op10_fingerprints,
}

SQL: dict[str, str] = {
    "op5_url_rules": """
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        u AS (SELECT DISTINCT host, path FROM p),
        m AS (SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
              FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path)
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
    """,
}
