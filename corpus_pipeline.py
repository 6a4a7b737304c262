"""A corpus through several stages, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyboard.llm import stages
from tallyboard.llm.shared import stage_table, table

STAGES = [
    ("toxicity", stages.clean),
    ("line dedup", stages.lines),
    ("n-gram Jaccard join", stages.near_copies),
    ("benchmark decontamination", stages.leaks),
    ("byte-level BPE", stages.encoded),
]
#: SQL cannot state a trained classifier or byte-pair merges; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
