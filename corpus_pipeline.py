"""Corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage works on what the one before it kept. All but the last return the columns of ``documents``: dropped rows
are gone, and text holds what is left of it, with n_chars its length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import packing, pii, quality, simhash, suffix_dedup
from barloom.llm.common import table, work_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality.filtered(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles) the document with the smallest id stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that start earlier in the corpus are cut out; every document stays."""
    return suffix_dedup.repeated_bytes(docs, whole_rows=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every document stays."""
    return pii.redacted(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can't express learned rules, components, suffix sorting or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the session's shared folder and read back.

    A stage's folder goes when the next one is written, and the last one's when the session's file system is closed.
    """
    docs = table(spark, sf_dir, "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if before is not None:
            files.delete(before, True)
        before = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
