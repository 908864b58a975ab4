"""The corpus pipeline: toxicity, exact and near deduplication, mixing, packing; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from quire.llm.queries import table, tokenizer_path
from quire.llm.store import drop, fresh, materialize, swept


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles and similarity 0.8, as stages on word shingles take them (only
    op8's own contract has four)."""
    return near_dedup.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage leaves beside its rows goes when they are written, and they when the next
    stage's are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh(spark, f"stage-{name}")
        with swept(spark):
            docs = materialize(spark, stage(spark, docs, sf_dir), name, path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
