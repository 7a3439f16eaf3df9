"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm.common import table, written
from meridia.llm.decontaminate import stage_decontamination
from meridia.llm.mixing import stage_mixing
from meridia.llm.near_dedup import stage_near_dedup
from meridia.llm.quality import stage_quality
from meridia.llm.sharding import stage_sharding

STAGES = [
    ("quality classifier", stage_quality),
    ("near-duplicate removal", stage_near_dedup),
    ("benchmark decontamination", stage_decontamination),
    ("mixing to target weights", stage_mixing),
    ("sharding", stage_sharding),
]
#: The classifier, the signatures and the suffix arrays have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, as often as they are mixed in, with shard and slot. Each stage states what it does with nulls, empty
    and very long texts, ties, repeated rows and columns of clashing names; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k + 1 == len(STAGES) else written(docs, "stage")
    return docs
