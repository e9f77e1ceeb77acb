"""Cleaning and packing of a document corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hallspark.llm import stages
from hallspark.llm.common import materialize

STAGES = stages.STAGES
#: A stage needs models and searches that SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
