"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm.bpe import bpe_round_trip
from eventloom.llm.common import read
from eventloom.llm import decontaminate, html, lines, ngram_join, pii, quality, suffix_dedup, urls
from eventloom.llm.warc import warc_round_trip


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return bpe_round_trip(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, figures of the base rule, base_failed and the verdict of every whole text."""
    return quality.quality_report(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and digest of what is left of every whole text."""
    return lines.report(read(spark, sf_dir, "documents"))


def op3_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines of every length that have a word."""
    return lines.report(read(spark, sf_dir, "documents"), lines.SHORT_SITES)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every whole text held against every benchmark item."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's capture by the entries that held at its fetch time."""
    return urls.report(read(spark, sf_dir, "pages").select("page_id", "url"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and digest of every whole text without its repeated 400-byte strings."""
    return suffix_dedup.removed(read(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(read(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every whole text."""
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base spans, and all spans."""
    return pii.report(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return warc_round_trip(read(spark, sf_dir, "pages")).drop("url", "payload")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op3_line_dedup_all": op3_line_dedup_all,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html": op7_html,
    "op8_ngram_join": op8_ngram_join,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op2_quality": quality.ORACLE_SQL,
    "op3_line_dedup": lines.ORACLE_SQL,
    "op3_line_dedup_all": lines.ALL_ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_url_filter": urls.ORACLE_SQL,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS winner FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN winner IS NULL OR page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN winner IS NOT NULL AND page_id <> winner THEN winner END AS refers_to
        FROM w""",
}
