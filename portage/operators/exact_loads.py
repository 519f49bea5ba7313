"""Loads that add their rows exactly once, though a task, or the whole load, runs again.

A database takes the rows of each task in a transaction of its own. If an executor is lost between a commit and its report,
the task runs again and its rows are there twice. Here they go to a staging table first, each with the load, the try, the
part and the attempt of the task that wrote it. Of each part one attempt counts. Its rows are moved to the target by one
statement, with the row that says that the load is done, so a load that has this row is not moved again.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from portage.operators import table_sinks
from portage.sources import tables
from portage.sources.files import quoted
from portage.sources.tables import CATALOG, TableAccess

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns that staged rows have besides their own.
TAGS = ("load_id", "try_id", "part", "attempt")
_LOADS = "load_id string, try_id string, state string, row_count bigint, rows_before bigint"
PLANNED, DONE = "planned", "done"


def tag_rows(batches: Iterator[pa.RecordBatch], load_id: str, try_id: str) -> Iterator[pa.RecordBatch]:
    """Rows with the load, the try, and the part and attempt of the task that has them."""
    task = TaskContext.get()
    for batch in batches:
        n = batch.num_rows
        tags = [pa.array([load_id] * n), pa.array([try_id] * n), pa.array([task.partitionId()] * n, pa.int64()),
                pa.array([task.taskAttemptId()] * n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *tags], names=[*batch.schema.names, *TAGS])


@dataclass
class ExactLoad:
    """One load, named by ``load_id``, into a table of a database or of the session's catalog.

    ``<table>_staging`` and ``<table>_loads`` stand beside the target, which has to be there. One load of a table is moved
    at a time.
    """

    spark: SparkSession
    access: TableAccess
    table: str
    load_id: str
    try_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def staging(self) -> str:
        return f"{self.table}_staging"

    @property
    def loads(self) -> str:
        return f"{self.table}_loads"

    def _read(self, table: str) -> DataFrame:
        return tables.scan_table(self.spark, self.access, table, single_connection=True)

    def state(self) -> tuple[str, str, int, int] | None:
        """try_id, state, rows and rows before of this load's last row; None before its first. Done comes last."""
        if not tables.table_exists(self.spark, self.access, self.loads):
            return None
        own = self._read(self.loads).where(F.col("load_id") == self.load_id)
        done_first = F.struct((F.col("state") == DONE).alias("done"), "row_count")
        row = own.agg(F.max_by(F.struct("try_id", "state", "row_count", "rows_before"), done_first).alias("row")).first()["row"]
        return tuple(row) if row else None

    def stage(self, df: DataFrame) -> None:
        """Write the rows to the staging table, by as many tasks as they have parts."""
        clash = [name for name in df.columns if name.lower() in TAGS]
        if clash:
            raise ValueError(f"columns of a staged load cannot be named {', '.join(clash)}")
        load_id, try_id = self.load_id, self.try_id
        kinds = [StructField(name, StringType() if name.endswith("_id") else LongType()) for name in TAGS]
        tagged = df.mapInArrow(lambda batches: tag_rows(batches, load_id, try_id), StructType([*df.schema, *kinds]))
        table_sinks.load_table(tagged, self.access, self.staging)

    def whole_rows(self) -> DataFrame:
        """The staged rows of this try, of one attempt for each part: the first, of which any has committed all its rows."""
        own = self._read(self.staging).where((F.col("load_id") == self.load_id) & (F.col("try_id") == self.try_id))
        first = own.groupBy("part").agg(F.min("attempt").alias("attempt"))
        return own.join(first, ["part", "attempt"], "left_semi").drop(*TAGS)

    def finish(self) -> int:
        """Move the staged rows to the target and mark the load as done; return their number."""
        count = self.whole_rows().count()
        if self.access.dialect == CATALOG:
            self._record(PLANNED, count, self.spark.table(self.table).count())
            self._move(count)
        else:
            _run_in_one_transaction(self.spark, self.access, self.table, self.move_statements(count))
        return count

    def _record(self, state: str, count: int, before: int) -> None:
        row = [(self.load_id, self.try_id, state, count, before)]
        table_sinks.load_table(self.spark.createDataFrame(row, _LOADS), self.access, self.loads)

    def _move(self, count: int) -> None:
        columns = [quoted(name) for name in self.spark.table(self.table).columns]
        table_sinks.load_table(self.whole_rows().select(*columns), self.access, self.table)
        self._record(DONE, count, 0)

    def resume(self) -> int | None:
        """Rows of this load if it is done, or was stopped in the move and is now; None if it has to be staged again.

        The catalog has no transactions: whether a move that was planned has happened is told by the target's rows.
        """
        found = self.state()
        if found is None:
            return None
        self.try_id, state, count, before = found
        if state == DONE:
            return count
        there = self.spark.table(self.table).count()
        if there == before:
            self._move(count)
        elif there == before + count:
            self._record(DONE, count, 0)
        else:
            raise RuntimeError(f"{self.table} has {there} rows; load {self.load_id} found {before} and has {count}")
        return count

    def move_statements(self, count: int) -> list[str]:
        """What a database runs as one transaction: the rows of the first attempt of each part, and the mark."""
        names = [name for name in self._read(self.staging).columns if name not in TAGS]
        target, staging, loads = (tables.split_table_name(self.access.dialect, t)[1] for t in (self.table, self.staging, self.loads))
        own = f"load_id = '{_text(self.load_id)}' AND try_id = '{_text(self.try_id)}'"
        first = f"SELECT part, MIN(attempt) AS attempt FROM {staging} WHERE {own} GROUP BY part"
        picked = ", ".join(f"s.{name}" for name in names)
        return [
            f"INSERT INTO {target} ({', '.join(names)}) SELECT {picked} FROM {staging} s JOIN ( {first} ) f "
            f"ON s.part = f.part AND s.attempt = f.attempt WHERE s.{own.replace(' AND ', ' AND s.')}",
            f"INSERT INTO {loads} (load_id, try_id, state, row_count, rows_before) "
            f"VALUES ('{_text(self.load_id)}', '{_text(self.try_id)}', '{DONE}', {count}, 0)",
            f"DELETE FROM {staging} WHERE load_id = '{_text(self.load_id)}'",
        ]


def load_exactly_once(df: DataFrame, access: TableAccess, table: str, load_id: str) -> int:
    """Append the rows of one named load to a table, unless it has them, and return their number.

    A load that is called again under its name, after a failure or not, adds what is missing and nothing twice.
    """
    load = ExactLoad(df.sparkSession, access, table, load_id)
    if access.dialect == CATALOG and not df.sparkSession.catalog.tableExists(table):
        df.limit(0).write.saveAsTable(table)
    if access.dialect != CATALOG and not tables.table_exists(df.sparkSession, access, load.loads):
        load._record("created", 0, 0)  # so that the mark has a table to go to
    known = load.resume() if access.dialect == CATALOG else _rows_if_done(load.state())
    if known is not None:
        return known
    load.try_id = uuid.uuid4().hex
    load.stage(df)
    return load.finish()


def _rows_if_done(state: tuple | None) -> int | None:
    return state[2] if state and state[1] == DONE else None


def _text(value: str) -> str:
    return value.replace("'", "''")


def _run_in_one_transaction(spark: SparkSession, access: TableAccess, table: str, statements: list[str]) -> None:
    options = tables.connection_options(access, table)
    spark._jvm.java.lang.Class.forName(options["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], options["user"], options["password"])
    try:
        connection.setAutoCommit(False)
        for statement in statements:
            connection.createStatement().executeUpdate(statement)
        connection.commit()
    finally:
        connection.close()
