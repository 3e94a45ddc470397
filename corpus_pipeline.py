"""A corpus pipeline: five stages from raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its
result is written as Parquet and read again as the documents of the next stage. Null, empty and
repeated rows go through every stage as its operator says; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marginflow.llm import decontaminate, jaccard, mixing, quality, sharding
from marginflow.llm.frames import stored_order

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# SQL cannot express the stage of near duplicates, so the tests have a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that fail one or lost too much."""
    kept = quality.clean(docs)
    return kept.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, so a document may repeat or be left out.

    The rows lie shard by shard of the mix, shuffled in each, and are written in that order.
    """
    return mixing.copies(mixing.mix(docs)).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place in it, in the order in which the mix was written."""
    placed = sharding.shard(docs, order=stored_order(docs))
    return placed.select(*COLUMNS, "size", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", shards),
]


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared one of the session, or a local one where it has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        return tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's rows are written and read again."""
    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
