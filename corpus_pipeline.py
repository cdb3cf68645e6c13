"""A corpus pipeline over documents: quality rules, near-duplicate removal, redaction of personal data, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs and all results but the last have the columns of documents. Stages are
written and reread between calls: run() does it in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampliweave.llm import bpe, minhash, mixing, pii, quality
from ampliweave.llm.common import cut, table
from ampliweave.llm.queries import TOKENIZERS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule rejects and whose n-grams look no less like the labelled good rows than like the raw corpus."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the least doc_id."""
    return minhash.dedup(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets and n_chars counted anew."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks for: up to three times, or not at all."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, for each document of the mix."""
    return bpe.encode_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", redact_pii), ("mixing", mix_sources), ("bpe", tokenise)]

#: The near-duplicate stage can't be put in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
