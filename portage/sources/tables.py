"""Scans of database tables and queries: JDBC databases, or the tables of the session's own catalog."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

CATALOG = "Catalog"
#: Values that a sampled partitioning takes to the driver, about; twice as many at most.
SAMPLE = 20000

# Per database kind the port, the driver class, how many dotted parts name a table, a random
# number from 0 to 1, and URL arguments.
# MySQL honours the fetch size only with a server-side cursor; the rewrite arguments send a batch as one statement.
DIALECTS = {
    "MySQL": {
        "url": "jdbc:mysql://{host}:{port}/{database}?useCursorFetch=true&rewriteBatchedStatements=true",
        "port": 3306,
        "driver": "com.mysql.cj.jdbc.Driver",
        "parts": 2,
        "random": "RAND()",
    },
    "PSQL": {
        "url": "jdbc:postgresql://{host}:{port}/{database}?reWriteBatchedInserts=true",
        "port": 5432,
        "driver": "org.postgresql.Driver",
        "parts": 3,
        "random": "RANDOM()",
    },
}


@dataclass(frozen=True)
class TableAccess:
    """How to reach a database. ``Catalog`` stands for the session's catalog and needs no host or login."""

    dialect: str = CATALOG
    host: str = ""
    username: str = ""
    password: str = field(default="", repr=False)
    port: int | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Partitioning:
    """Split of a JDBC read over connections by ranges of a column.

    Choose an indexed column with distinct values, such as the primary key: one value is never split. Ranges are equally
    wide, between bounds that are given or asked from the database. ``even`` asks it for ranges with equally many rows
    instead, for columns with gaps or dense spots, which sorts the column there. ``sampled`` takes such ranges from a
    bounded random sample of the column, and gives a value that fills more than a range predicates of its own, split by
    ranges of ``second_column`` if there is one. ``predicates``, one per partition and together true once for every row,
    replace the ranges.
    """

    column: str = ""
    num_partitions: int = 1
    lower: str | None = None
    upper: str | None = None
    even: bool = False
    sampled: bool = False
    second_column: str = ""
    predicates: tuple[str, ...] = ()


def split_table_name(dialect: str, table: str) -> tuple[str, str]:
    """Database and the name inside it: ``db.table`` for MySQL, ``db.schema.table`` for PSQL."""
    parts = table.split(".")
    wanted = DIALECTS[dialect]["parts"]
    if len(parts) != wanted or not all(parts):
        raise ValueError(f"a {dialect} table name needs {wanted} dotted parts: {table}")
    return parts[0], ".".join(parts[1:])


def connection_options(access: TableAccess, table: str) -> dict[str, str]:
    """URL, driver and login for the database that holds a table."""
    dialect = DIALECTS[access.dialect]
    database, _ = split_table_name(access.dialect, table)
    return {
        "url": dialect["url"].format(host=access.host, port=access.port or dialect["port"], database=database),
        "driver": dialect["driver"],
        "user": access.username,
        "password": access.password,
        "fetchsize": "10000",
        **access.options,
    }


def query_text(table: str, dml: str = "") -> str:
    """The relation to read: the user's query, or all columns of the table."""
    query = dml.strip().rstrip(";") or f"SELECT * FROM {table}"
    return f"( {query} ) AS query"


def range_options(partitioning: Partitioning, lower, upper) -> dict[str, str]:
    return {
        "partitionColumn": partitioning.column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitioning.num_partitions),
    }


def _literal(value: int | float | Decimal | date) -> str:
    return f"'{value}'" if isinstance(value, date) else str(value)


def sample_query(relation: str, partitioning: Partitioning, random: str, rows: int) -> str:
    """Query for about ``SAMPLE`` values of the column, and of the second one, from all parts of a relation of ``rows`` rows."""
    second = f", {partitioning.second_column} AS w" if partitioning.second_column else ""
    some = f" AND {random} < {SAMPLE / rows:.12f}" if rows > SAMPLE else ""
    return f"( SELECT {partitioning.column} AS v{second} FROM {relation} WHERE {partitioning.column} IS NOT NULL{some} LIMIT {2 * SAMPLE} ) AS sample"


def depth_predicates(partitioning: Partitioning, sample: Sequence[tuple]) -> list[str]:
    """Predicates of about equally many sampled rows, true once for every row, sampled or not.

    The sample has pairs of a value and a second value, or None. Values with more than a share have predicates of their
    own. Rows without a value belong to the first range.
    """
    column, second, wanted = partitioning.column, partitioning.second_column, max(partitioning.num_partitions, 1)
    seconds: dict = {}
    for value, other in sample:
        if value == value:  # not NaN, which databases sort behind all numbers
            seconds.setdefault(value, []).append(other)
    share = sum(map(len, seconds.values())) / wanted
    ranges, points = [], []  # (condition, sampled rows)
    low, full = None, 0

    def close(high: str | None) -> None:
        tests = [test for test in (low, high) if test]
        ranges.append((" AND ".join(tests) or "1 = 1", full))

    for value, others in sorted(seconds.items()):
        hot = len(others) > share
        if hot or full >= share:
            close(f"{column} < {_literal(value)}")
            low, full = f"{column} {'>' if hot else '>='} {_literal(value)}", 0
        if hot:
            parts = even_predicates(second, _lowest_of(others, math.ceil(len(others) / share))) if second else ["1 = 1"]
            points += [f"{column} = {_literal(value)}" + ("" if part == "1 = 1" else f" AND {part}") for part in parts]
        else:
            full += len(others)
    close(None)
    if len(ranges) == 1 and not points:
        return ["1 = 1"]
    ranges[0] = (f"({ranges[0][0]} OR {column} IS NULL)", ranges[0][1])
    # Short ranges between hot values share a connection.
    packed, filled = [], share
    for condition, rows in ranges:
        if packed and filled + rows <= share:
            packed[-1], filled = f"{packed[-1]} OR ({condition})", filled + rows
        else:
            packed, filled = [*packed, f"({condition})"], rows
    return packed + points


def _lowest_of(values: Sequence, parts: int) -> list:
    """Lowest value of each of ``parts`` equally full ranges; values that are missing belong to the first."""
    ordered = sorted(value for value in values if value is not None and value == value)
    return [ordered[i * len(ordered) // parts] for i in range(parts)] if ordered else []


def even_bounds_query(relation: str, column: str, num_partitions: int) -> str:
    """Query for the lowest value of each of ``num_partitions`` ranges with equally many rows."""
    ranked = f"SELECT {column}, NTILE({num_partitions}) OVER (ORDER BY {column}) AS part FROM {relation}"
    filled = f"( {ranked} WHERE {column} IS NOT NULL ) AS filled"
    return f"( SELECT MIN({column}) AS lo FROM {filled} GROUP BY part ) AS bounds"


def even_predicates(column: str, lows: Sequence[int | float | Decimal | date]) -> list[str]:
    """One predicate per range from their lowest values. Rows without a value belong to the first.

    Only for numbers, dates and times: the database may sort text in an order of its own.
    """
    ordered = sorted(set(lows))
    if not ordered:
        return ["1 = 1"]
    texts = [_literal(low) for low in ordered]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(texts[1:], texts[2:])]
    if len(texts) == 1:
        return ["1 = 1"]
    return [f"({column} < {texts[1]} OR {column} IS NULL)", *inner, f"{column} >= {texts[-1]}"]


def scan_table(
    spark: SparkSession, access: TableAccess, table: str, dml: str = "", partitioning: Partitioning | None = None,
    single_connection: bool = False,
) -> DataFrame:
    """A table, or the result of a query that the database runs.

    Without a partitioning, one connection reads all of it; ``single_connection`` says that this is meant.
    """
    if access.dialect == CATALOG:
        return spark.sql(f"SELECT * FROM {query_text(table, dml)}") if dml.strip() else spark.table(table)
    relation, options = query_text(table, dml), connection_options(access, table)

    def load(dbtable: str, **ranges: str) -> DataFrame:
        return spark.read.format("jdbc").options(dbtable=dbtable, **options, **ranges).load()

    if partitioning is None:
        if not single_connection:
            logger.warning("%s is read through one connection; give a partition column, or single_connection=true", table)
        return load(relation)
    column, predicates = partitioning.column, list(partitioning.predicates)
    if not predicates and partitioning.sampled:
        rows = load(f"( SELECT COUNT(*) AS n FROM {relation} ) AS total").first()["n"]
        sample = load(sample_query(relation, partitioning, DIALECTS[access.dialect]["random"], rows))
        texts = [kind.name for kind in sample.schema if kind.dataType.typeName() == "string"]
        if texts:
            raise ValueError("sampled ranges need number, date or time columns; a database may sort text in its own way")
        second = F.col("w") if partitioning.second_column else F.lit(None)
        predicates = depth_predicates(partitioning, [tuple(row) for row in sample.select("v", second).collect()])
    if not predicates and partitioning.even:
        bounds = load(even_bounds_query(relation, column, partitioning.num_partitions))
        if bounds.schema["lo"].dataType.typeName() == "string":
            raise ValueError(f"even ranges need a number, date or time column, which {column} is not")
        predicates = even_predicates(column, [row["lo"] for row in bounds.collect()])
    if predicates:
        login = {name: value for name, value in options.items() if name != "url"}
        return spark.read.jdbc(options["url"], relation, predicates=predicates, properties=login)
    lower, upper = partitioning.lower, partitioning.upper
    if lower is None or upper is None:
        lo, hi = load(f"( SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {relation} ) AS bounds").first()
        if lo is None:
            return load(relation)
        lower, upper = (lo if lower is None else lower), (hi if upper is None else upper)
    return load(relation, **range_options(partitioning, lower, upper))


def table_exists(spark: SparkSession, access: TableAccess, table: str) -> bool:
    if access.dialect == CATALOG:
        return spark.catalog.tableExists(table)
    database, relation = split_table_name(access.dialect, table)
    schema, _, name = relation.rpartition(".")
    dml = (
        "SELECT COUNT(*) AS found FROM information_schema.tables "
        f"WHERE table_schema = '{schema or database}' AND table_name = '{name}'"
    )
    return scan_table(spark, access, table, dml, single_connection=True).first()["found"] > 0
