"""Each new file of a landing directory once, with the files that are done in a table of their own.

Spark's file stream keeps the names of all files that it has ever seen in the driver. Here they are a ledger: a folder of
rows, one per file as it was when it was taken (path, length, time of change). New files are the directory's listing
without the ledger's rows, an anti-join on the executors. They are taken in batches of bounded size, so the driver holds
the names of one batch at most.

A batch is planned before it is loaded: its files are in the ledger first, then its rows replace whatever the target has of
that batch, then the batch is marked as done. A run that stops in between leaves a planned batch, which the next run loads
again, with the same files, before it looks for others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage import storage
from portage.functions import naming
from portage.sources import files, listing

_FILES = "path string, length bigint, modified timestamp, batch bigint"
_DONE = "batch bigint"
MOST_FILES = 1000
#: Batches after which the ledger's small files are joined.
COMPACT_AFTER = 50


@dataclass(frozen=True)
class Ledger:
    """Files and finished batches of one target, in a folder. One run at a time may use it."""

    spark: SparkSession
    path: str

    def _folder(self, name: str) -> str:
        return storage.join(storage.qualify(self.spark, self.path), name)

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self._folder(name)
        if not storage.exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(storage.glob_escape(folder))

    def files(self) -> DataFrame:
        """path, length, modified and batch of every file that was planned."""
        return self._read("files", _FILES)

    def last(self, name: str = "files") -> int:
        """Number of the last planned (or, of ``done``, finished) batch; -1 before the first."""
        schema = _FILES if name == "files" else _DONE
        return self._read(name, schema).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def plan(self, new: DataFrame, batch: int, most_files: int) -> None:
        """Put the oldest new files into the ledger as one batch."""
        some = new.orderBy("modified", "path").limit(most_files).select("path", "length", "modified")
        some.coalesce(1).write.mode("overwrite").parquet(storage.join(self._folder("files"), f"batch={batch}"))

    def finish(self, batch: int) -> None:
        row = self.spark.createDataFrame([(batch,)], _DONE)
        row.coalesce(1).write.mode("append").parquet(self._folder("done"))

    def compact(self) -> None:
        """Join the files of all batches but the last into the last one's folder, then drop theirs.

        Rows that stand in both for a moment, or after a failure, change nothing: a file is done if it is there.
        """
        last = self.last()
        older = self.files().where(F.col("batch") < last).select("path", "length", "modified").distinct()
        older.coalesce(1).write.mode("append").parquet(storage.join(self._folder("files"), f"batch={last}"))
        for name in storage.glob_names(self.spark, storage.join(storage.glob_escape(self._folder("files")), "batch=*")):
            if name != f"batch={last}":
                storage.delete(self.spark, storage.join(self._folder("files"), name))


def new_files(ledger: Ledger, directory: str, template: str, filesystem: dict | None = None) -> DataFrame:
    """path, length and modified of the files whose name fits and that the ledger doesn't have as they are now.

    ``template`` is a name with a stamp token, or a regular expression for whole names. A file that was replaced has
    another length or time and is new again, whatever its age.
    """
    token = naming.token_of(template)
    prefix = template.split(token, 1)[0] if token else ""
    names = listing.list_names(ledger.spark, directory, prefix, filesystem)
    fits = naming.is_stamped(F.col("name"), template) if token else F.col("name").rlike(f"^(?:{template})$")
    return names.where(fits).join(ledger.files(), ["path", "length", "modified"], "left_anti")


def ingest_new_files(
    ledger: Ledger, directory: str, template: str, schema, table: str, most_files: int = MOST_FILES,
    filesystem: dict | None = None, **csv_options,
) -> int:
    """Load what is new into a catalog table that is partitioned by ``batch``, and return the number of batches loaded.

    Each batch replaces its own partition, so one that is loaded again adds nothing. Rows of a file that was replaced come
    in again, under their own batch. Lines and headers that do not fit are errors, and their batch stays planned.
    """
    spark, loaded = ledger.spark, 0
    while True:
        batch = ledger.last()
        if batch == ledger.last("done"):
            new = new_files(ledger, directory, template, filesystem)
            if new.isEmpty():
                return loaded
            batch += 1
            ledger.plan(new, batch, most_files)
        _load(ledger, batch, schema, table, csv_options)
        ledger.finish(batch)
        loaded += 1
        if batch % COMPACT_AFTER == COMPACT_AFTER - 1:
            ledger.compact()


def _load(ledger: Ledger, batch: int, schema, table: str, csv_options: dict) -> None:
    spark = ledger.spark
    paths = [storage.glob_escape(row["path"]) for row in ledger.files().where(F.col("batch") == batch).select("path").collect()]
    rows = files.scan_delimited(spark, *paths, schema=schema, **csv_options)
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], rows.schema).withColumn("batch", F.lit(batch).cast("bigint"))
        empty.write.partitionBy("batch").saveAsTable(table)
    # Columns in the table's order; the partition is named, so no other is replaced.
    ordered = rows.select(*(files.quoted(name) for name in spark.table(table).columns if name != "batch"))
    spark.sql(f"INSERT OVERWRITE {table} PARTITION (batch = {int(batch)}) SELECT * FROM {{rows}}", rows=ordered)
