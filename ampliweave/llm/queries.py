"""The registered queries of the training-data operators: each applies one to its whole table and derives the columns of its contract."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, mpeg, pii, quality, repeats, secrets, warc, wordpiece
from .common import cut, table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return mixing.in_training_order(planned).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_digest(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.read_back(cut(mpeg.store(table(spark, sf_dir, "documents")), "media"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", emit=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SQL = {
    "op1_mixing": r"""
        WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '-')) AS h,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s),
        o AS (SELECT *, row_number() OVER k AS place, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                     sum(weight) OVER () - coalesce(sum(weight) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_rest
              FROM w WINDOW k AS (ORDER BY source_size / weight, encode(source) NULLS LAST)),
        f AS (SELECT * FROM o WHERE rest * weight <= 3 * source_size * weight_rest ORDER BY place LIMIT 1),
        t AS (SELECT o.source, o.source_size, CASE WHEN o.place >= f.place THEN CAST(f.rest AS DOUBLE) * o.weight / f.weight_rest ELSE CAST(3 * o.source_size AS DOUBLE) END AS target FROM o, f),
        c AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(size, floor(target) - pos)) + greatest(0, least(size, floor(target) - source_size - pos)) + greatest(0, least(size, floor(target) - 2 * source_size - pos)) AS BIGINT) AS taken
        FROM c""",
    "op6_secrets": secrets.oracle_sql(),
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html AS h, max(page_id) AS top, count(*) AS n FROM p GROUP BY html)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN strlen(html) >= 1000 AND n > 1 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 1000 AND n > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM p JOIN g ON html = h""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
