"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, mixing, mkv, neardup, quality, sitetree, topk, urls
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mkv.document_packets(table(spark, sf_dir, "documents"))


def matroska_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4_matroska's rows: all but byte offsets, laces, clusters and cues."""
    rows = op4_matroska(spark, sf_dir).where("packet is not null")
    return rows.select("doc_id", "packet", "track", "timestamp_ns", "byte_size", "payload_md5")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.expand(table(spark, sf_dir, "conversations"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.known_bad(pages))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_mixing, op3_quality, op4_matroska, op5_bpe, op6_html_extraction, op7_chat, op8_top_k, op9_url_filter, op10_near_duplicates, matroska_payloads)
}

_WEIGHT = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in mixing.TARGET_WEIGHTS.items()) + f" ELSE {mixing.DEFAULT_WEIGHT} END"

ORACLE_SQL: dict[str, str] = {
    "matroska_payloads": mkv.SQL,
    "op7_chat": chat.SQL,
    "op8_top_k": topk.SQL,
    "op2_mixing": f"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens,
         md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k
  FROM documents
), paced AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS DOUBLE)
            / CAST({_WEIGHT} AS DOUBLE) AS virtual_finish
  FROM sized WHERE n_tokens > 0
), spent AS (
  SELECT *, sum(n_tokens) OVER (ORDER BY virtual_finish, source, k ROWS UNBOUNDED PRECEDING) AS upto FROM paced
)
SELECT doc_id, source, n_tokens, virtual_finish FROM spent
WHERE upto <= (SELECT CAST(floor(CAST(sum(n_tokens) AS DOUBLE) * {mixing.BUDGET_SHARE}) AS BIGINT) FROM paced)
""",
}
