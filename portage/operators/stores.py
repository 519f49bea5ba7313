"""Where the run log and the registry live: a folder of Parquet files, or a table."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage import storage
from portage.operators import table_sinks
from portage.sources import tables
from portage.sources.tables import TableAccess


@dataclass(frozen=True)
class FolderStore:
    """Rows in a folder. ``partition_by`` gives each value of a column its own sub-folder."""

    path: str
    schema: str
    partition_by: tuple[str, ...] = ()

    def append(self, rows: DataFrame) -> None:
        """Add any number of rows, one such append at a time."""
        rows.write.mode("append").partitionBy(*self.partition_by).parquet(self.path)

    def append_few(self, rows: DataFrame) -> None:
        """Add a few rows while others may append too.

        Jobs that write to one folder share its temporary sub-folder, and the first to end takes it from the rest. So
        the rows are written elsewhere, and their files, with names of their own, are moved in.
        """
        spark, staged = rows.sparkSession, storage.join(self.path, f"_append_{uuid.uuid4().hex}")
        try:
            rows.coalesce(1).write.partitionBy(*self.partition_by).parquet(staged)
            places = storage.join(storage.glob_escape(staged), "*=*") if self.partition_by else ""
            folders = [f"/{name}" for name in storage.glob_names(spark, places)] if places else [""]
            for folder in folders:
                storage.make_directory(spark, self.path + folder)
                for part in storage.glob_names(spark, storage.glob_escape(staged + folder) + "/part-*"):
                    storage.rename(spark, f"{staged}{folder}/{part}", f"{self.path}{folder}/{part}")
        finally:
            storage.delete(spark, staged)

    def compact(self, spark: SparkSession, value: str) -> None:
        """Join the files of one value of the partition column into one, while nothing is appended to it.

        The new folder stands beside the old one before it takes its place.
        """
        rows = self.read(spark, value)
        token = uuid.uuid4().hex
        staged, old = storage.join(self.path, f"_compact_{token}"), storage.join(self.path, f"_old_{token}")
        try:
            rows.coalesce(1).write.partitionBy(*self.partition_by).parquet(staged)
            for folder in storage.glob_names(spark, storage.join(storage.glob_escape(staged), "*=*")):
                storage.rename(spark, storage.join(self.path, folder), old)
                storage.rename(spark, storage.join(staged, folder), storage.join(self.path, folder))
        finally:
            storage.delete(spark, staged)
            storage.delete(spark, old)

    def read(self, spark: SparkSession, value: str | None = None) -> DataFrame:
        """All rows, or those of one value of the (only) partition column; then only its sub-folder is listed."""
        folder = self.path
        plain = value is not None and re.fullmatch(r"[A-Za-z0-9_.-]+", value)
        if plain and self.partition_by:  # other values are escaped in folder names
            folder = storage.join(self.path, f"{self.partition_by[0]}={value}")
        if not storage.exists(spark, folder):
            return spark.createDataFrame([], self.schema)
        reader = spark.read.schema(self.schema).option("basePath", self.path)
        rows = reader.parquet(storage.glob_escape(folder))
        return rows if value is None else rows.where(F.col(self.partition_by[0]) == value)


@dataclass(frozen=True)
class TableStore:
    """Rows in a table of a database or of the session's catalog; the first append makes it."""

    access: TableAccess
    table: str
    schema: str
    partition_by: tuple[str, ...] = ()

    def append(self, rows: DataFrame) -> None:
        """Add rows; a table that was made with fewer columns takes those that it has."""
        spark = rows.sparkSession
        if tables.table_exists(spark, self.access, self.table):
            known = {name.lower() for name in tables.scan_table(spark, self.access, self.table, single_connection=True).columns}
            rows = rows.select(*(name for name in rows.columns if name.lower() in known))
        table_sinks.load_table(rows, self.access, self.table)

    def append_few(self, rows: DataFrame) -> None:
        self.append(rows)

    def read(self, spark: SparkSession, value: str | None = None) -> DataFrame:
        if not tables.table_exists(spark, self.access, self.table):
            return spark.createDataFrame([], self.schema)
        rows = tables.scan_table(spark, self.access, self.table, single_connection=True)
        return rows if value is None else rows.where(F.col(self.partition_by[0]) == value)
