"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portage import storage
from portage.session import shared_dir

#: Options for tables whose rows are some MB of bytes: each is a row group of its own, so readers hold one at a time.
LARGE_ROWS = {
    "parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false",
}


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows of ``df``, written as Parquet under a new shared folder and read from there."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator no longer needs once its last step has been stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = shared_dir(self.spark, label)
        self.paths.append(path)
        df.write.option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            storage.delete(self.spark, path)
        self.paths = []


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of the rows' size. Used to choose numbers of partitions, never to choose rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
