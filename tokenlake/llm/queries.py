"""The registered queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import collocations, decontamination, jaccard_join, langid, license_scan, near_dedup, oracles, packing, quality_cnn, quality_rules, spelling, substring_dedup, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(n: int, which: int) -> Column:
    """Is crc32(doc_id as text) mod n equal to which? Never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == which, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _bucket(4, 2)
    model = langid.fit(docs.filter(~held_out).select("text", "lang", F.col("doc_id").alias("key")))
    return langid.identify_languages(docs, model, held_out)


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _bucket(3, 1)
    model = quality_cnn.fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return quality_cnn.score_quality(docs, model, held_out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select("rest.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(docs).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_quality(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.best_fit_packing(docs).select("rest.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spelling.Plan(spoil=31))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM cut
), rules(ruled, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT p.*, (SELECT max_by({'rule': rule_host || rule_path, 'ruled': ruled}, length(rule_host || rule_path)) FROM rules
               WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best
  FROM parts p
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.ruled, 'allow') AS verdict FROM judged
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express over whole tables; the others are tested against brute force or held-out rows."""
    return {
        "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op4_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op5_repetition_quality": oracles.REPETITION_QUALITY,
        "op7_near_dedup": oracles.NEAR_DEDUP,
        "op8_url_filter": OP8_SQL,
        "op11_phrase_collocations": oracles.PHRASE_COLLOCATIONS,
        "op12_spelling_variants": oracles.SPELLING_VARIANTS,
        "op13_jaccard_join": oracles.JACCARD_JOIN,
    }
