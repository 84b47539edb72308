"""The corpus pipeline: toxic documents go, exact and near copies go, sources are mixed, what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a table; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from landrank.functions.storage import removed, tables_of
from landrank.llm import bpe, exact_dedup, mixing, simhash, toxicity
from landrank.llm.common import shared_folder, table
from landrank.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: SimHash and the draws of the mix have no form in SQL; the tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table stays until the next one's is written, and what it stored on its way goes with it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        with tables_of(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if i:
            removed(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(path)
    return docs
