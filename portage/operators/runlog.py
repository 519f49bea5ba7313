"""The run log: one typed row per read, write and copy, and the queries on it."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portage.functions import naming
from portage.operators.stores import FolderStore, TableStore
from portage.sources.tables import TableAccess

# Columns of the run log and of the report, in order.
SCHEMA = (
    "pipeline string, run_id string, service string, task_order int, source_access string, source_path_table string, "
    "source_file_dml string, operation string, record_count bigint, target_access string, target_path_table string, "
    "target_file string, status string, timestamp timestamp"
)
# What is stored besides: the order in which rows came, which settles equal times.
STORED = SCHEMA + ", sequence bigint"
SOURCE_FILES = "run_id string, task_order int, source_file string"
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
TASK_KEYS = ["pipeline", "run_id", "service", "task_order"]
REPORT_COLUMNS = [
    "pipeline", "run_id", "service", "task_order", "source_path_table", "source_file_dml",
    "record_count AS Records", "target_path_table", "target_file", "status",
]
SUCCESS, FAILED = "success", "failed"


@dataclass(frozen=True)
class AuditRow:
    pipeline: str
    run_id: str
    service: str
    task_order: int
    source_access: str
    source_path_table: str
    source_file_dml: str
    operation: str
    record_count: int | None
    target_access: str
    target_path_table: str
    target_file: str
    status: str


class RunLog:
    """Append-only log; old rows are never changed.

    In a folder, each run has its own sub-folder, so that a report opens only its run's files.
    """

    def __init__(self, spark: SparkSession, path: str = "", access: TableAccess | None = None, table: str = ""):
        self.spark = spark
        if access is None:
            self.store = FolderStore(path, STORED, ("run_id",))
            self.sources = FolderStore(path.rstrip("/") + "_source_files", SOURCE_FILES, ("run_id",))
        else:
            self.store = TableStore(access, table, STORED, ("run_id",))
            self.sources = TableStore(access, table + "_source_files", SOURCE_FILES, ("run_id",))

    def append(self, *rows: AuditRow, at: datetime | None = None) -> None:
        """Append rows in their order, all with one clock value: the given one, or now."""
        clock = F.current_timestamp() if at is None else naming.as_run_ts(at).cast("timestamp")
        start = time.time_ns()
        values = [(*(getattr(row, name) for name in COLUMNS[:-1]), start + i) for i, row in enumerate(rows)]
        plain = self.spark.createDataFrame(values, SCHEMA.rsplit(", ", 1)[0] + ", sequence bigint")
        self.store.append_few(_typed(plain.withColumn("timestamp", clock)))

    def append_rows(self, rows: DataFrame) -> None:
        """Append a whole log, such as one brought over from elsewhere; it may have a ``sequence``."""
        self.store.append(_typed(rows))

    def append_source_files(self, run_id: str, task_order: int, names: DataFrame) -> None:
        """Names of the files that a task read from a directory, one row each; executors write them."""
        self.sources.append_few(names.select(
            F.lit(run_id).alias("run_id"), F.lit(task_order).alias("task_order"), "source_file"))

    def read(self, run_id: str | None = None, with_sequence: bool = False) -> DataFrame:
        """The log, or one run's part of it, for which no other run's files are listed."""
        rows = self.store.read(self.spark, run_id)
        return _typed(rows) if with_sequence else rows.select(*COLUMNS)

    def compact(self, run_id: str) -> None:
        """Join the small files of a run that has ended into one. Logs in tables are left to their database."""
        if isinstance(self.store, FolderStore):
            self.store.compact(self.spark, run_id)

    def read_source_files(self, run_id: str | None = None) -> DataFrame:
        return self.sources.read(self.spark, run_id).select("run_id", "task_order", "source_file")

    def correct_status(self, run_id: str, task_order: int, operation: str, status: str) -> None:
        """Set the status of one operation of one task, by appending a correcting row.

        Its time is later than what it corrects, also where another host's clock is ahead.
        """
        scope = (F.col("run_id") == run_id) & (F.col("task_order") == task_order) & (F.col("operation") == operation)
        later = F.greatest(F.current_timestamp(), F.col("timestamp") + F.expr("INTERVAL 1 MICROSECOND"))
        corrected = corrections(self.read(run_id, with_sequence=True).where(scope), F.lit(status), later)
        self.store.append_few(_typed(corrected.withColumn("sequence", F.lit(time.time_ns()))))


def _typed(rows: DataFrame) -> DataFrame:
    rows = with_sequence(rows)
    return rows.select(*(F.col(name).cast(kind) for name, kind in (column.split() for column in STORED.split(", "))))


def with_sequence(rows: DataFrame) -> DataFrame:
    """Rows with a ``sequence``, null in logs that have none."""
    return rows if "sequence" in rows.columns else rows.withColumn("sequence", F.lit(None).cast("bigint"))


def latest_rows(log: DataFrame, run_id: str, match_service: bool = False) -> DataFrame:
    """Rows of a run at the latest time of their task, ties kept, by a self-join.

    The reading that users know joins without the service; ``match_service`` joins on all keys of the group.
    """
    run = log.where(F.col("run_id") == run_id)
    latest = run.groupBy(*TASK_KEYS).agg(F.max("timestamp").alias("timestamp"))
    keys = [key for key in TASK_KEYS if match_service or key != "service"]
    if not match_service:
        latest = latest.drop("service")
    return run.join(latest, [*keys, "timestamp"], "inner")


def latest_rows_window(log: DataFrame, run_id: str) -> DataFrame:
    """The same rows, matched on all keys, as a window; each task keeps only its own newest rows before the shuffle."""
    newest_first = Window.partitionBy(*TASK_KEYS).orderBy(F.desc("timestamp"))
    ranked = log.where(F.col("run_id") == run_id).withColumn("newest", F.rank().over(newest_first))
    return ranked.where("newest = 1").drop("newest")


def report(latest: DataFrame) -> DataFrame:
    """The status report over latest rows, in task order."""
    return latest.selectExpr(*REPORT_COLUMNS).orderBy(F.col("task_order").cast("int"))


def run_report(log: DataFrame, run_id: str) -> DataFrame:
    """One row per task of a run: its newest state, where a write or copy at the same time goes before other rows, then
    the row that came last; in logs without that order the file name decides."""
    run = with_sequence(log.where(F.col("run_id") == run_id))
    moved = F.col("operation").isin("write", "copy")
    return report(_newest(run, TASK_KEYS, F.desc("timestamp"), moved.desc()))


def corrections(rows: DataFrame, status, timestamp) -> DataFrame:
    """Correcting rows: the newest row of each operation of each task, with another status and a later time."""
    return current_state(rows).withColumn("status", status).withColumn("timestamp", timestamp)


def current_state(log: DataFrame) -> DataFrame:
    """Newest row of each operation of each task; of equal times the row that came last, else the file name decides."""
    return _newest(with_sequence(log), [*TASK_KEYS, "operation"], F.desc("timestamp"))


def _newest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row of each group; each task keeps its own first rows before the shuffle."""
    ties = [F.desc(name) for name in ("sequence", "source_file_dml", "record_count", "status")]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties)))
    return ranked.where("_rank = 1").select(*COLUMNS)
