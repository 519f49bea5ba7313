"""Good rows and rejected lines of one pass over a text source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portage.session import shared_dir
from portage.sources.files import REJECTED_LINE, SOURCE_FILE, quoted

_FLAG = "_rejected"


@dataclass(frozen=True)
class Split:
    """Rows of the source's columns, and (source_file, line) of what does not fit them, with both numbers."""

    good: DataFrame
    rejected: DataFrame
    good_rows: int
    rejected_rows: int


def split_rejects(rows: DataFrame) -> Split:
    """Sort the rows of ``scan_with_rejects`` into two folders of one shared table.

    The source is read and parsed once, by the write that does the sorting; both numbers come from the footers of the
    files that it committed. A task that runs again replaces its files.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "split")
    marked = rows.withColumn(_FLAG, F.col(REJECTED_LINE).isNotNull())
    marked.write.partitionBy(_FLAG).parquet(path)
    # The flag is given as a column of the folders, so that a side without rows is an empty table.
    table = spark.read.schema(marked.schema).parquet(path)
    columns = [F.col(quoted(name)) for name in rows.columns if name not in (REJECTED_LINE, SOURCE_FILE)]
    good = table.where(~F.col(_FLAG)).select(*columns)
    rejected = table.where(_FLAG).select(SOURCE_FILE, F.col(REJECTED_LINE).alias("line"))
    return Split(good, rejected, good.count(), rejected.count())


def write_rejects(rejected: DataFrame, path: str, run_id: str, task_order: int) -> None:
    """Keep the rejected lines of one task of a run below ``path``; the task's earlier ones are replaced."""
    named = rejected.select("source_file", "line", F.lit(run_id).alias("run_id"), F.lit(task_order).alias("task_order"))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "task_order").parquet(path)
