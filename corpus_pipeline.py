"""The corpus pipeline: five stages from raw documents to shards, each written and read again.

Every stage works on all that the one before kept.  All but the last return the columns of documents,
further ones too, whatever their names.  No stage fails on nulls in any column, empty or very long texts,
ties, repeated rows or empty tables; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, mixing, quality, sharding, simhash
from strandline.llm.common import passing, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier, learnt from the labels, rejects.

    Each row is judged by its text, a null one as an empty one.  Without labels of both kinds nothing is dropped.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the least id.

    Null and blank texts are one group; repeated rows are one document; rows of one id with different texts
    are documents of their own; rows without an id all stay.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, words of it substituted or not.

    Rows are judged by id and text, so rows without an id too; null and blank texts hold nothing and stay;
    with an empty benchmark all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights; a document served in two epochs is there twice.

    A null source is one like others; documents without words, null texts among them, are never served;
    repeated rows are served each; ties within a source go by id and size.
    """
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard and its slot there.

    Rows without an id share a shard; null texts have no bytes; repeated rows have slots of their own.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier and the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark):  # what a stage stores on its way goes once its result is written
            made = stage(spark, docs, sf_dir)
            docs = stored(made, f"pipeline-{name}", passes=False)
    return docs
