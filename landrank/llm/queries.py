"""The queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, mixing, ogg, quality, simhash, token_counts, toxicity, url_filter
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The list that the URL filter is given: domains of spam, and as many others as make a list of usual length.
SPAM = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = [f"{n}.example.{end}" for n in SPAM for end in ("com", "net", "org")] + [f"blocked{i}.example.org" for i in range(20_000)]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), LISTED_DOMAINS)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), words=3, radius=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def llm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 8: the payload read back."""
    return op8_ogg_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 9: sizes and targets."""
    return op9_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_byte_bpe, op3_url_filter, op4_quality, op5_exact_dedup,
        op6_simhash, op7_language_id, op8_ogg_media, op9_source_mix, op10_toxicity, llm_payloads, llm_mix_targets,
    )
}

#: SQL for what SQL can express; it runs over the same tables.
ORACLE = {
    "op3_url_filter": """
        WITH parts AS (
          SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
        ), ruled AS (
          SELECT *, CASE
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
            regexp_matches(host, '(^|\\.)((adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)|blocked(0|[1-9][0-9]{0,3}|1[0-9]{4})\\.example\\.org)$') AS listed FROM split
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
        FROM ruled
    """,
    "op5_exact_dedup": """
        WITH plain AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents
        ), ranked AS (
          SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY norm) AS group_size
          FROM plain WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
    "llm_payloads": """
        WITH raw AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        sized AS (SELECT *, CASE WHEN n = 0 THEN 64 ELSE n + (64 - n % 64) % 64 END AS m FROM raw)
        SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(encode(t) || from_hex(repeat('00', (m - n)::INTEGER))) AS payload_sha256 FROM sized
    """,
    "llm_mix_targets": """
        WITH sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
        ), sources AS (
          SELECT source, sum(size)::BIGINT AS s, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w FROM sized GROUP BY source
        ), ordered AS (
          -- those that reach three times their size soonest first; what the rest share, were the ones before at their limit
          SELECT *, row_number() OVER (ORDER BY s / w, source IS NULL, encode(source)) AS place, ((SELECT sum(s) FROM sources) - 3 * coalesce(sum(s) OVER before, 0)) / ((SELECT sum(w) FROM sources) - coalesce(sum(w) OVER before, 0)) AS level
          FROM sources WINDOW before AS (ORDER BY s / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), water AS (SELECT coalesce(arg_min(level, place) FILTER (level * w <= 3 * s), 1e300) AS level FROM ordered)
        SELECT doc_id, size, s AS source_size, round(least(3e0 * s, w * water.level), 3) AS target FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source, water
    """,
}
