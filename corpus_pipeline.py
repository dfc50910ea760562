"""The corpus pipeline: quality rules, near duplicates, decontamination, pseudonyms, mixing.

Each stage takes the rows that the one before it kept, written and read again as Parquet, and its
decision takes effect: rejected rows, all but one document of a group and leaked rows are gone, values
are replaced. The last stage adds slot, place and epoch and may show a document in several epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxlake.llm import decontaminate, fertility, mixing, prefix_join, pseudonyms
from taxlake.llm.queries import PSEUDONYM_KEY
from taxlake.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.passing_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_join.one_per_group(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(docs, PSEUDONYM_KEY)


def mixing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_order),
]

#: The tokenisers of the first stage have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
