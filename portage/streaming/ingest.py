"""Each new file of a landing directory, exactly once, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from portage import storage
from portage.operators import table_sinks
from portage.sources.files import STRICT
from portage.sources.tables import TableAccess, scan_table, table_exists

# Spark would pass over files older than a week than the newest one, which a sync that keeps times produces.
ANY_AGE = "36500d"


def read_new_files(
    spark: SparkSession,
    pattern: str,
    schema: StructType | str,
    header: bool = True,
    delimiter: str = ",",
    max_files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of the rows of files that fit a glob, which may also match folders of part files.

    A file is new until the checkpoint has it, however old it is. Lines and headers that do not fit are errors, as in
    ``scan_delimited``.
    """
    chosen = {**STRICT, "maxFileAge": ANY_AGE, **options}
    reader = spark.readStream.schema(schema).options(header=header, delimiter=delimiter, **chosen)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(pattern)


def ingest_available(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a catalog table, then stop. The checkpoint remembers the files that are done.

    Spark's file sink commits each batch by its number, so a batch that runs again after a failure adds nothing twice.
    """
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", storage.qualify(stream.sparkSession, checkpoint)).toTable(table)
    query.awaitTermination()
    return query


def ingest_available_to_path(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same into a folder of Parquet files."""
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
    query = writer.option("checkpointLocation", storage.qualify(stream.sparkSession, checkpoint)).start(path)
    query.awaitTermination()
    return query


def ingest_available_to_database(
    stream: DataFrame, access: TableAccess, table: str, checkpoint: str, batch_column: str = "batch_id"
) -> StreamingQuery:
    """The same into any table, through a column that holds the number of the batch.

    A batch that runs again is left out when the table has it whole. A database that has only a part of it, because its
    tasks commit one by one, is not touched: the batch fails until those rows are deleted.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        found = _loaded_rows(batch.sparkSession, access, table, batch_column, batch_id)
        if not found:
            table_sinks.load_table(batch.withColumn(batch_column, F.lit(batch_id).cast("bigint")), access, table)
        elif found != batch.count():
            raise RuntimeError(f"{table} has {found} rows of batch {batch_id}, which is not all of it; delete them")

    writer = stream.writeStream.trigger(availableNow=True).foreachBatch(load)
    query = writer.option("checkpointLocation", storage.qualify(stream.sparkSession, checkpoint)).start()
    query.awaitTermination()
    return query


def _loaded_rows(spark: SparkSession, access: TableAccess, table: str, batch_column: str, batch_id: int) -> int:
    if batch_id == 0 and not table_exists(spark, access, table):
        return 0
    dml = f"SELECT COUNT(*) AS found FROM {table} WHERE {batch_column} = {batch_id}"
    return scan_table(spark, access, table, dml, single_connection=True).first()["found"]
