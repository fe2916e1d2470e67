"""The corpus pipeline: five stages from raw documents to shards, each one written and read again by the next.

1. quality: documents that the classifier rejects go;
2. near_copies: one document of each group of near copies stays;
3. decontamination: documents that hold a benchmark item go;
4. mixing: rows are repeated or dropped so that each source's words meet its target;
5. sharding: every row, text and all, gets its shard and slot by a uniform shuffle.

Defined cases, for every stage: null and empty texts, ties, repeated rows and null ids are handled as the operator's own
module states; an empty table gives an empty one; extra columns, of whatever name, are passed on; labels or a benchmark
without rows reject nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foretide.llm import decontaminate, mixing, quality, sharding, simhash
from foretide.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, the fingerprints and the shuffles are not expressible in SQL: tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
