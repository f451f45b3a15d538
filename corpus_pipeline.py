"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import stages
from cadenza.llm.store import Scratch, close_since, mark

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix),
    ("sharding", stages.shard),
]
#: A fitted classifier and seeded hashes decide; tests compare each stage with its operator instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        begun = mark()
        docs = scratch.table(stage(spark, docs, sf_dir), docs)
        close_since(begun)  # the stage's own tables have done their work
    return STAGES[-1][1](spark, docs, sf_dir)
