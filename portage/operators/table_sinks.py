"""Loads into database tables: JDBC databases, or the tables of the session's own catalog."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from portage.operators.counting import RowCount, committed_rows
from portage.sources.tables import CATALOG, TableAccess, connection_options, split_table_name

logger = logging.getLogger(__name__)

APPEND, OVERWRITE = "append", "overwrite"


def load_mode(load_type: str) -> str:
    mode = (load_type or APPEND).lower()
    if mode not in (APPEND, OVERWRITE):
        raise ValueError(f"load type must be Append or Overwrite: {load_type}")
    return mode


def writer_options(
    access: TableAccess,
    table: str,
    truncate: bool = False,
    num_partitions: int | None = None,
    batch_size: int = 10000,
    column_types: str | None = None,
) -> dict[str, str]:
    """JDBC options for a load. Each partition is one connection and transaction.

    ``num_partitions`` bounds them, which also narrows the stage above the load; unset, the plan's own number holds.
    """
    _, relation = split_table_name(access.dialect, table)
    options = connection_options(access, table)
    options.update(
        dbtable=relation,
        batchsize=str(batch_size),
        truncate=str(truncate).lower(),
    )
    if num_partitions is not None:
        options["numPartitions"] = str(num_partitions)
    if column_types is not None:
        options["createTableColumnTypes"] = column_types
    return options


def load_table(
    df: DataFrame, access: TableAccess, table: str, load_type: str = "Append", truncate: bool = False, **jdbc
) -> int | None:
    """Append to a table or replace its rows, and return the number of rows that it has taken.

    Overwrite makes the table anew, unless ``truncate`` keeps its definition. Columns are matched by name. The number is
    that of the commit, or for a new or replaced table that of its rows; a database that does not report one gives None.
    """
    mode = load_mode(load_type)
    if access.dialect != CATALOG:
        counted = RowCount(df)
        options = writer_options(access, table, truncate, **jdbc)
        if df.sparkSession.sparkContext.getConf().get("spark.speculation", "false") == "true":
            logger.warning("spark.speculation may load rows twice through JDBC, where each task commits by itself")
        counted.df.write.format("jdbc").options(**options).mode(mode).save()
        return counted.reported()
    spark = df.sparkSession
    there = spark.catalog.tableExists(table)
    if there and (mode == APPEND or truncate):
        rows = df.select(*(_same_name(df, column) for column in spark.table(table).columns)) if mode == OVERWRITE else df
        verb = "INSERT INTO" if mode == APPEND else "INSERT OVERWRITE"
        taken = committed_rows(spark.sql(f"{verb} {table} BY NAME SELECT * FROM {{rows}}", rows=rows))
        if taken is not None:
            return taken
        return None if mode == APPEND else spark.table(table).count()
    df.write.mode(mode).saveAsTable(table)
    return spark.table(table).count()


def _same_name(df: DataFrame, column: str):
    """The column of that name, whatever characters are in it."""
    return df["`{}`".format(column.replace("`", "``"))]
