"""The corpus pipeline: quality, exact and near duplicates, benchmark passages, token ids.

Every stage takes what its predecessor kept, written as Parquet and read again, and works on all of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import remove_folder, remove_later, shared_folder, staging
from newsloom.llm.decontaminate import drop_contaminated
from newsloom.llm.exact_dedup import drop_exact
from newsloom.llm.quality_rules import keep_quality
from newsloom.llm.queries import codec_columns, tokenizer_path
from newsloom.llm.sentencepiece_codec import encode_documents
from newsloom.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays."""
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of ids and decoded text."""
    return codec_columns(encode_documents(docs, tokenizer_path()), "doc_id", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: Learned rules, SimHash components and token ids cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    The last one's output stays until ``release_staged`` is called or the process ends, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_later(spark, folder)
    before = None
    for name, stage in STAGES:
        with staging():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what a stage has read is not needed once it has written
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
