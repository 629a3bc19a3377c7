"""The corpus pipeline: quality, near-duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.

Defined cases: an empty table passes through all stages.  Null and empty texts
fail the quality rules.  Repeated rows and ties are one component of equal
fingerprints, of which one row stays.  Very long texts are read whole.  Null
languages, sources and ids are handled as the operators state; extra columns
travel along, whatever their names, up to the manifest.  A stage that is lost
with an executor is computed again from the Parquet of the stage before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, quality, sharding, simhash, store
from quillon.sources import scan


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from all languages reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled with the raked probability of their cell."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left gets a shard and a slot."""
    return sharding.assign(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", shards),
]

#: XXH64 fingerprints and their components have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again.

    What a stage saved on its way, and its input once it is no longer needed, are deleted; the last stage's rows stay.
    """
    store.ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = scan.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with store.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}.parquet")
        docs = scan.table(spark, folder, name)
        if before:
            store.remove(spark, f"{folder}/{before}.parquet")
        before = name
    return docs
