"""Cleaning and packing of ``documents`` in five stages, each written as a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portage.llm import decontamination, line_dedup, near_dedup, queries, quality_rules
from portage.llm.scratch import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good_documents(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents that are nothing else."""
    return line_dedup.keep_first_copies_of_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.keep_one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of 2048 tokens."""
    return queries.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark),
    ("packing", packed),
]

#: Hashed n-grams and tokenizer ids have no SQL form; tests compare the rows with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
