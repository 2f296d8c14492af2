"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.decontamination import decontaminate
from panelwright.llm.mixing import mixed_documents
from panelwright.llm.near_dup import drop_near_duplicates
from panelwright.llm.packing import packed_rows
from panelwright.llm.queries import VOCABULARY
from panelwright.llm.toxicity import drop_toxic
from panelwright.scratch import pin
from panelwright.session import ship_code


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_rows(docs, VOCABULARY)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near-dedup", one_of_each_group_stays),
    ("decontamination", benchmark_passages_go),
    ("mixing", sources_are_mixed),
    ("token packing", token_rows),
]

#: A learned score and byte-pair encoding have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
