"""A corpus pipeline from the operators of tessera.llm.

Each stage works on all documents that the one before it kept; run() writes every stage's result to the
shared folder and goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.decontaminate import decontaminated
from tessera.llm.near_dup import keep_one
from tessera.llm.packing import pack_documents
from tessera.llm.store import load, written
from tessera.llm.substring_dedup import dedup_texts
from tessera.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with texts handed to Python in small batches: executors run all stages, and what they once took they keep."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return without_toxic(docs, load(spark, sf_dir, "labels"))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each class of near-duplicates."""
    return keep_one(docs)


@in_small_batches
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id has; n_chars follows the text."""
    out = dedup_texts(docs)
    return out.withColumn("n_chars", _length(out)).select(*docs.columns) if "n_chars" in docs.columns else out


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other numbers and names."""
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document."""
    return pack_documents(docs)


def _length(docs: DataFrame) -> Column:
    return F.length("text").cast(docs.schema["n_chars"].dataType)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashing and models are not SQL: the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
