"""The corpus pipeline: quality filter, exact and near deduplication, mixing, packing. run() applies STAGES to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriplex.llm.common import new_folder, table
from veriplex.llm.exact import exact_dedup
from veriplex.llm.mixing import mix_documents
from veriplex.llm.packing import best_fit
from veriplex.llm.rules import quality_filter
from veriplex.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("packing", packing)]

#: SQL can't fit the rule ensemble or chain fingerprints into classes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
