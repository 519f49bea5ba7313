"""Every operator as a query on the given tables, next to the SQL that yields the same rows.

A query writes a whole table through the operator into a new shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portage import storage
from portage.functions import naming, params
from portage.operators import copying, exact_loads, file_sinks, registry, runlog, table_sinks
from portage.operators.registry import Registry
from portage.operators.runlog import RunLog
from portage.plans import spec
from portage.plans.runs import run_tasks
from portage.plans.spec import TaskSpec
from portage.plans.transfers import TRANSFERS, RunContext
from portage.session import shared_dir, stored
from portage.sources import files, manifest, tables
from portage.sources.tables import TableAccess
from portage.streaming import ingest
from portage.streaming.ledger import Ledger, ingest_new_files

RUN_TS = datetime(2024, 2, 1, 12, 30, 30)
RUN_ID = "run-3"
WAREHOUSE = TableAccess()
RFC_QUOTES = {"escape": '"', "multiLine": "true"}
_OPEN_FILES = 32


@dataclass(frozen=True)
class Check:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str


CHECKS: dict[str, Check] = {}


def check(sql: str):
    """Register a query under its function's name."""

    def register(query):
        CHECKS[query.__name__] = Check(query, sql)
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ddl(df: DataFrame) -> str:
    """Schema as text, for a task's parameters."""
    return ", ".join(f"{column.name} {column.dataType.simpleString()}" for column in df.schema)


def new_database(spark: SparkSession) -> str:
    """A database of its own in the session's catalog, with its files in a shared folder."""
    location = shared_dir(spark, "tables")
    name = "check_" + location.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{location}'")
    return name


def new_context(spark: SparkSession, work: str) -> RunContext:
    return RunContext(
        spark, RunLog(spark, f"{work}/run_log"), "daily", "run-1", tables={"warehouse": WAREHOUSE}, run_ts=RUN_TS
    )


def transfer(context: RunContext, service: str, **task_params: str) -> str:
    result = TRANSFERS[service](context, TaskSpec(service, task_params), 0)
    if not result.ok:
        raise RuntimeError(result.error)
    return result.target


def land_by_stamp(
    df: DataFrame, directory: str, base: str, stamp: Column, extension: str, delimiter: str = ","
) -> None:
    """Split rows over stamped files ``<base>_<stamp>.<extension>``, each a folder of parts.

    The rebalance hint splits a stamp that holds many rows over several tasks.
    """
    spark = df.sparkSession
    staged = f"{directory}/_split"
    writer = df.withColumn("stamp", stamp).hint("rebalance", "stamp").write.partitionBy("stamp")
    writer.options(header=True, delimiter=delimiter, **file_sinks.LOSSLESS).csv(staged)
    for name in storage.glob_names(spark, f"{staged}/stamp=*"):
        storage.rename(spark, f"{staged}/{name}", f"{directory}/{base}_{name.split('=', 1)[1]}.{extension}")
    storage.delete(spark, staged)


def write_folders(df: DataFrame, path: str, *keys: str) -> None:
    """Split rows over Parquet folders by a few keys, with one file for each key of a task.

    A task keeps the files of its keys open side by side. Spark would else sort all rows of the task by the keys first, and
    the memory of that sort grows with the rows. Keys beyond ``_OPEN_FILES`` in one task are sorted still.
    """
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, _OPEN_FILES)
    try:
        df.write.partitionBy(*keys).parquet(path)
    finally:
        conf.set(name, before)


# Files ---------------------------------------------------------------------------------------------------------------


@check("SELECT * FROM orders")
def csv_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    published = file_sinks.write_delimited(orders, f"{shared_dir(spark, 'csv')}/orders.csv")
    return files.scan_delimited(spark, published.path, schema=orders.schema)


@check("SELECT * REPLACE (c_custkey::INTEGER AS c_custkey) FROM customer")
def csv_scan_inferred(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    published = file_sinks.write_delimited(customer, f"{shared_dir(spark, 'csv')}/customer.csv", delimiter="|")
    return files.scan_delimited(spark, published.path, delimiter="|")


@check("SELECT * FROM documents")
def csv_multiline(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    published = file_sinks.write_delimited(documents, f"{shared_dir(spark, 'csv')}/documents.csv", escape='"')
    return files.scan_delimited(spark, published.path, schema=documents.schema, **RFC_QUOTES)


@check("SELECT * FROM part")
def txt_tab_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    published = file_sinks.write_delimited(part, f"{shared_dir(spark, 'txt')}/part.txt", delimiter="\t")
    return files.scan_file(spark, published.path, delimiter="\t", schema=part.schema).df


@check("SELECT * FROM supplier")
def headerless_scan(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    published = file_sinks.write_raw(supplier, f"{shared_dir(spark, 'raw')}/supplier.txt")
    raw = files.scan_raw(spark, published.path)
    return raw.select(
        *(F.col(f"_c{i}").cast(column.dataType).alias(column.name) for i, column in enumerate(supplier.schema))
    )


@check("SELECT * FROM lineitem")
def parquet_scan(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    published = file_sinks.write_parquet(lineitem, f"{shared_dir(spark, 'parquet')}/lineitem.parquet")
    return files.scan_file(spark, published.path).df


@check("SELECT * FROM orders")
def directory_scan(spark, sf_dir):
    """One directory with a CSV, a text and a Parquet file; a nested directory is not part of it."""
    orders = table(spark, sf_dir, "orders")
    work = shared_dir(spark, "directory")
    file_sinks.write_delimited(orders.where("o_orderstatus = 'F'"), f"{work}/finished.csv")
    file_sinks.write_delimited(orders.where("o_orderstatus = 'O'"), f"{work}/open.txt")
    file_sinks.write_parquet(orders.where("NOT (o_orderstatus <=> 'F' OR o_orderstatus <=> 'O')"), f"{work}/other.parquet")
    file_sinks.write_delimited(orders.where("o_orderstatus = 'P'"), f"{work}/nested/more.csv")
    return files.scan_file(spark, work, schema=orders.schema).df


@check("SELECT * FROM events")
def publish_parts(spark, sf_dir):
    """Many parts under one name, none of them lost."""
    events = table(spark, sf_dir, "events").repartition(4)
    path = f"{shared_dir(spark, 'parts')}/events_yyyymmdd.csv"
    published = file_sinks.write_delimited(events, path)
    return files.scan_delimited(spark, published.path, schema=events.schema)


@check("SELECT * FROM events")
def publish_single(spark, sf_dir):
    """All rows in one file, with one header line."""
    events = table(spark, sf_dir, "events").repartition(4)
    published = file_sinks.write_delimited(events, f"{shared_dir(spark, 'single')}/events.csv", layout="file")
    return files.scan_delimited(spark, published.path, schema=events.schema)


@check("SELECT * FROM orders")
def directory_column_orders(spark, sf_dir):
    """A directory whose files name the same columns in three orders."""
    orders, work = table(spark, sf_dir, "orders"), shared_dir(spark, "directory")
    names = orders.columns
    for status, turned in (("F", names), ("O", names[::-1]), ("P", names[2:] + names[:2])):
        some = orders.where(F.col("o_orderstatus") == status).select(*turned)
        file_sinks.write_delimited(some, f"{work}/{status}.{'txt' if status == 'O' else 'csv'}")
    file_sinks.write_parquet(orders.where("NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)"), f"{work}/rest.parquet")
    return files.scan_file(spark, work, schema=orders.schema).df


_DAMAGED = """
SELECT CASE WHEN o_orderkey % 13 = 5 OR o_orderkey % 11 = 3 OR o_orderkey % 7 = 0 THEN 'rejected' ELSE 'good' END AS side,
  CASE WHEN o_orderkey % 13 = 5 THEN concat(o_orderkey, ',', o_custkey)
    WHEN o_orderkey % 11 = 3 THEN concat(o_orderkey, ',', o_custkey, ',', o_orderstatus, ',', o_orderpriority, ',more')
    WHEN o_orderkey % 7 = 0 THEN concat(o_orderkey, ',x', o_custkey, ',', o_orderstatus, ',', o_orderpriority)
    ELSE concat(o_orderkey, ',', o_custkey, ',', o_orderstatus, ',', o_orderpriority) END AS line
FROM {orders}
"""


def _load_damaged_orders(spark, sf_dir):
    """Load lines of which some have too few or too many values, or a word for a number."""
    work, loaded = shared_dir(spark, "rejects"), f"{new_database(spark)}.orders"
    lines = spark.sql(_DAMAGED, orders=table(spark, sf_dir, "orders"))
    lines.select("line").write.text(f"{work}/orders_20240131.csv")
    context = new_context(spark, work)
    transfer(
        context, spec.FILE_TO_TABLE, source_s3_file_path=f"{work}/orders_yyyymmdd.csv", header_row="False",
        target_access_db="warehouse", target_table=loaded, on_bad_lines="reject", rejects_path=f"{work}/rejects",
        schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    )
    return context, work, loaded


@check(_DAMAGED.format(orders="orders"))
def csv_rejects(spark, sf_dir):
    """Both sides of a load: what the table has, and the lines that were kept apart."""
    _, work, loaded = _load_damaged_orders(spark, sf_dir)
    good = spark.table(loaded).select(F.lit("good").alias("side"), F.concat_ws(",", "*").alias("line"))
    return good.union(spark.read.parquet(f"{work}/rejects").select(F.lit("rejected"), "line"))


@check(f"""
WITH line AS ({_DAMAGED.format(orders="orders")})
SELECT o.operation, count(*) FILTER (o.side = 'all' OR o.side = line.side) AS record_count
FROM line, (VALUES ('read', 'all'), ('write', 'good'), ('reject', 'rejected')) AS o(operation, side) GROUP BY o.operation
""")
def csv_reject_counts(spark, sf_dir):
    """Read, written and rejected lines in the run log."""
    return _load_damaged_orders(spark, sf_dir)[0].log.read().select("operation", "record_count")


@check("""
SELECT CASE o_orderstatus WHEN 'F' THEN 'finished.csv' WHEN 'O' THEN 'open.txt' ELSE 'other.csv' END AS source_file,
  count(*) AS orders, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM orders GROUP BY 1
""")
def source_file_lineage(spark, sf_dir):
    """Rows of a directory by the file they come from; a folder of parts counts as its file."""
    orders, work = table(spark, sf_dir, "orders"), shared_dir(spark, "directory")
    file_sinks.write_delimited(orders.where("o_orderstatus = 'F'"), f"{work}/finished.csv")
    file_sinks.write_delimited(orders.where("o_orderstatus = 'O'"), f"{work}/open.txt")
    rest = orders.where("NOT (o_orderstatus <=> 'F' OR o_orderstatus <=> 'O')").repartition(4)
    file_sinks.write_delimited(rest, f"{work}/other.csv")
    rows = files.with_source_file(files.scan_directory(spark, work, schema=orders.schema))
    return rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


# Listings and names --------------------------------------------------------------------------------------------------

LATEST_DAY = "SELECT * FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)"


LATEST_QUARTER = """SELECT * FROM events WHERE (ts::DATE, hour(ts) // 6) =
    (SELECT max((ts::DATE, hour(ts) // 6)) FROM events)"""


def _land_events(spark, sf_dir, stamp):
    events = table(spark, sf_dir, "events")
    work = shared_dir(spark, "landing")
    land_by_stamp(events, work, "events", stamp, "csv")
    # Names that must lose: not a date, another base, another extension, not a direct child.
    decoy = events.where("event_type = 'error'")
    for name in ("events_99999999.csv", "other_20990101.csv", "events_20990101.txt", "sub/events_20990101.csv"):
        file_sinks.write_delimited(decoy, f"{work}/{name}")
    return work, events.schema


@check(LATEST_DAY)
def latest_by_date(spark, sf_dir):
    work, schema = _land_events(spark, sf_dir, F.date_format("ts", "yyyyMMdd"))
    return files.scan_file(spark, f"{work}/events_yyyymmdd.csv", schema=schema).df


@check(LATEST_QUARTER)
def latest_by_datetime(spark, sf_dir):
    """Four files a day, stamped with the hour that each quarter of the day begins with."""
    quarter = F.lpad((F.floor(F.hour("ts") / 6) * 6).cast("string"), 2, "0")
    work, schema = _land_events(spark, sf_dir, F.concat(F.date_format("ts", "yyyyMMdd"), quarter, F.lit("0000")))
    return files.scan_file(spark, f"{work}/events_yyyymmddHHMMSS.csv", schema=schema).df


@check("""
SELECT DISTINCT 'csv' AS extension, 'events_' || strftime(ts, '%Y%m%d') || '.csv' AS name FROM events
""")
def manifest_names(spark, sf_dir):
    work = shared_dir(spark, "landing")
    land_by_stamp(table(spark, sf_dir, "events"), work, "events", F.date_format("ts", "yyyyMMdd"), "csv")
    return manifest.names_by_extension(manifest.list_files(spark, work))


@check("""
SELECT event_id,
  strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m%d%H%M%S') AS second,
  event_type || '_' || strftime(ts, '%Y%m%d') || '.csv' AS dated,
  event_type || '_' || strftime(ts, '%Y%m%d%H%M%S') || '.txt' AS timed,
  event_type || '_' || strftime(ts, '%Y%m%d%H%M%S') || '.csv' AS from_table,
  'u' || user_id || '.csv' AS from_source
FROM events
""")
def stamped_names(spark, sf_dir):
    kind, ts = F.col("event_type"), F.col("ts")
    folder = F.concat(F.lit("out/"), kind, F.lit("/"))
    timed = F.concat(folder, kind, F.lit("_yyyymmddHHMMSS.txt"))
    source_name = F.concat(F.lit("u"), "user_id", F.lit(".csv"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        naming.date_stamp(ts).alias("day"),
        naming.datetime_stamp(ts).alias("second"),
        naming.stamp_name(F.concat(kind, F.lit("_yyyymmdd.csv")), ts).alias("dated"),
        naming.target_file_name(timed, source_name, ts).alias("timed"),
        naming.table_file_name(F.concat(F.lit("db.public."), kind), ts).alias("from_table"),
        naming.target_file_name(folder, source_name, ts).alias("from_source"),
    )


@check(r"""
SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(url, '/', 3) AS bucket,
  array_to_string(list_slice(string_split(url, '/'), 4, len(string_split(url, '/')) - 1), '/') AS prefix,
  split_part(url, '/', -1) AS file,
  regexp_extract(split_part(url, '/', -1), '\.([^./]+)$', 1) AS extension,
  regexp_extract(split_part(url, '/', -1), '^(.*)_[^_]*$', 1) AS base,
  CASE WHEN regexp_extract(split_part(url, '/', -1), '\.([^./]+)$', 1) = 'txt' THEN chr(9) ELSE ',' END AS delimiter
FROM pages
""")
def path_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", naming.split_path(F.col("url")).alias("parts"))
    name = F.col("parts.file")
    return pages.select(
        "page_id",
        "parts.*",
        naming.file_extension(name).alias("extension"),
        naming.base_name(name).alias("base"),
        naming.delimiter_for(name).alias("delimiter"),
    )


_NAMES_SQL = """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN 'e_' || strftime(ts, '%Y%m%d') || '.csv' WHEN 1 THEN 'e_' || strftime(ts, '%Y%m%d') || '.csv.bak'
  WHEN 2 THEN 'e_2024' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || '15.csv'
  WHEN 3 THEN 'x' || strftime(ts, '%Y%m%d') || '.csv' ELSE 'e_' || strftime(ts, '%Y%m%d%H%M%S') || '.csv' END AS name
FROM events
"""


def _event_names(spark, sf_dir):
    number, day = F.col("event_id") % 5, F.date_format("ts", "yyyyMMdd")
    month = F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")
    name = (
        F.when(number == 0, F.concat(F.lit("e_"), day, F.lit(".csv")))
        .when(number == 1, F.concat(F.lit("e_"), day, F.lit(".csv.bak")))
        .when(number == 2, F.concat(F.lit("e_2024"), month, F.lit("15.csv")))
        .when(number == 3, F.concat(F.lit("x"), day, F.lit(".csv")))
        .otherwise(F.concat(F.lit("e_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".csv")))
    )
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"))


@check(rf"""
SELECT event_id, name FROM ({_NAMES_SQL}) WHERE regexp_matches(name, '^e_\d{{8}}\.csv$')
  AND try_strptime(substr(name, 3, 8), '%Y%m%d') IS NOT NULL
""")
def stamp_filter(spark, sf_dir):
    return manifest.stamped(_event_names(spark, sf_dir), "e_yyyymmdd.csv")


@check(rf"SELECT max(name) AS name FROM ({_NAMES_SQL}) WHERE regexp_matches(name, '^e_\d{{14}}\.csv$')")
def latest_name(spark, sf_dir):
    return manifest.latest_name(_event_names(spark, sf_dir), "e_yyyymmddHHMMSS.csv")


# Tables --------------------------------------------------------------------------------------------------------------


def _store(spark, sf_dir, *names):
    database = new_database(spark)
    for name in names:
        table_sinks.load_table(table(spark, sf_dir, name), WAREHOUSE, f"{database}.{name}")
    return database


@check("SELECT * FROM orders")
def table_scan(spark, sf_dir):
    return tables.scan_table(spark, WAREHOUSE, f"{_store(spark, sf_dir, 'orders')}.orders")


@check("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def table_query(spark, sf_dir):
    database = _store(spark, sf_dir, "orders")
    dml = f"SELECT * FROM {database}.orders WHERE o_orderstatus = 'F';"
    return tables.scan_table(spark, WAREHOUSE, f"{database}.orders", dml)


@check("""
SELECT c_mktsegment, count(*) AS orders, max(o_totalprice) AS largest
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def table_query_join_agg(spark, sf_dir):
    database = _store(spark, sf_dir, "orders", "customer")
    dml = (
        f"SELECT c_mktsegment, count(*) AS orders, max(o_totalprice) AS largest FROM {database}.orders "
        f"JOIN {database}.customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
    )
    return tables.scan_table(spark, WAREHOUSE, f"{database}.orders", dml)


@check("SELECT * FROM orders")
def table_append(spark, sf_dir):
    orders, target = table(spark, sf_dir, "orders"), f"{new_database(spark)}.orders"
    table_sinks.load_table(orders.where("o_orderkey % 2 = 0"), WAREHOUSE, target, "Append")
    table_sinks.load_table(orders.where("NOT (o_orderkey % 2 <=> 0)"), WAREHOUSE, target, "Append")
    return spark.table(target)


@check("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def table_overwrite(spark, sf_dir):
    """Overwrite makes the table anew, here with fewer columns."""
    database = _store(spark, sf_dir, "orders")
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")
    table_sinks.load_table(some, WAREHOUSE, f"{database}.orders", "Overwrite")
    return spark.table(f"{database}.orders")


@check("SELECT * FROM orders WHERE o_orderstatus = 'O'")
def table_truncate(spark, sf_dir):
    """Overwrite that keeps the table's definition; columns are matched by name."""
    database = _store(spark, sf_dir, "orders")
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    turned = some.select(*reversed(some.columns))
    table_sinks.load_table(turned, WAREHOUSE, f"{database}.orders", "Overwrite", truncate=True)
    return spark.table(f"{database}.orders")


@check("SELECT * FROM orders")
def table_load_once(spark, sf_dir):
    """A load whose first part was written by two attempts, and which is called again when it is done."""
    orders, target = table(spark, sf_dir, "orders"), f"{new_database(spark)}.orders"
    orders.limit(0).write.saveAsTable(target)
    load = exact_loads.ExactLoad(spark, WAREHOUSE, target, "2024-01-31")
    load.stage(orders.repartition(4))
    twice = stored(spark.table(load.staging).where("part = 0"), "attempt")
    table_sinks.load_table(twice.withColumn("attempt", F.col("attempt") + 1_000_000), WAREHOUSE, load.staging)
    load.finish()
    exact_loads.load_exactly_once(orders, WAREHOUSE, target, "2024-01-31")
    return spark.table(target)


# Copies --------------------------------------------------------------------------------------------------------------


@check("SELECT * FROM lineitem")
def copy_tree(spark, sf_dir):
    work = shared_dir(spark, "copy")
    write_folders(table(spark, sf_dir, "lineitem").repartition(8), f"{work}/from", "l_returnflag")
    copying.copy_tree(spark, f"{work}/from", f"{work}/to")
    copied = spark.read.parquet(f"{work}/to")
    return copied.select(*table(spark, sf_dir, "lineitem").columns)


@check(LATEST_DAY)
def copy_latest(spark, sf_dir):
    work, schema = _land_events(spark, sf_dir, F.date_format("ts", "yyyyMMdd"))
    newest = files.resolve(spark, f"{work}/events_yyyymmdd.csv")
    copying.copy_file(spark, newest, f"{work}/out/newest.csv")
    return files.scan_delimited(spark, f"{work}/out/newest.csv", schema=schema)


@check("""
SELECT 'to/' || l_returnflag || '/' || l_linestatus || '.csv' AS target, count(*) AS lines
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def copy_keys(spark, sf_dir):
    """Relative keys under a new prefix, for a listing that holds a line count as length."""
    lineitem = table(spark, sf_dir, "lineitem")
    key = F.concat("l_returnflag", F.lit("/"), "l_linestatus", F.lit(".csv"))
    listing = lineitem.groupBy(key.alias("relative")).agg(F.count(F.lit(1)).alias("length"))
    plan = copying.copy_plan(listing.withColumn("path", F.concat(F.lit("from/"), "relative")), "to/")
    return plan.select("target", F.col("length").alias("lines"))


_ORDER_FILES = "SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) * 1000000 AS length FROM lineitem GROUP BY l_orderkey"


@check(f"""
SELECT count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes, 0 AS overfull, 0 AS with_company, true AS numbered FROM ({_ORDER_FILES})
""")
def copy_plan_balance(spark, sf_dir):
    """Copy tasks for a listing with a file for each order: none has over twice its share unless by one file, files of a
    share or more are alone, and the tasks are numbered without gaps."""
    share = 128 * 1024 * 1024
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity").cast("long") * 1000000).alias("length"))
    listing = sums.select(F.concat(F.lit("from/"), "l_orderkey").alias("path"), F.col("l_orderkey").cast("string").alias("relative"), "length")
    numbered, tasks = copying.balanced_tasks(copying.copy_plan(listing, "to"), share, files_per_range=5000)
    loads = numbered.groupBy("task").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))
    return loads.agg(
        F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"),
        F.count_if(F.col("bytes") > F.greatest(F.lit(2 * share), "largest")).cast("int").alias("overfull"),
        F.count_if((F.col("largest") >= share) & (F.col("objects") > 1)).cast("int").alias("with_company"),
        ((F.count(F.lit(1)) == tasks) & (F.max("task") == tasks - 1) & (F.min("task") == 0)).alias("numbered"),
    )


# Run log -------------------------------------------------------------------------------------------------------------

_LOG_SQL = """
SELECT event_type AS pipeline, CONCAT('run-', CAST(user_id % 10 AS STRING)) AS run_id,
  CASE (event_id % 12) % 5 WHEN 0 THEN 'SFTP-S3' WHEN 1 THEN 'S3-DB' WHEN 2 THEN 'DB-S3'
                           WHEN 3 THEN 'S3-S3' ELSE 'DB-DB' END AS service,
  CAST(event_id % 12 AS INT) AS task_order, 'src' AS source_access,
  CONCAT('in/', event_type) AS source_path_table, CONCAT('f_', CAST(event_id AS STRING), '.csv') AS source_file_dml,
  CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS operation, CAST(floor(value) AS BIGINT) AS record_count,
  'tgt' AS target_access, CONCAT('out/', event_type) AS target_path_table,
  CONCAT('o_', CAST(event_id AS STRING), '.csv') AS target_file,
  CASE WHEN value < 5 THEN 'failed' ELSE 'success' END AS status, ts AS timestamp
FROM {events}
"""
# A row belongs to the report once for each service of its task whose newest time it has.
_REPORT_SQL = """
, newest AS (SELECT DISTINCT pipeline, run_id, task_order, service,
    max(timestamp) OVER (PARTITION BY pipeline, run_id, task_order, service) AS top FROM log WHERE run_id = 'run-3'),
tops AS (SELECT pipeline, run_id, task_order, list(top) AS every FROM newest GROUP BY ALL),
shown AS (SELECT log.*, unnest(list_filter(every, lambda top: top = timestamp)) AS top
    FROM log JOIN tops USING (pipeline, run_id, task_order))
SELECT pipeline, run_id, service, task_order, source_path_table, source_file_dml, record_count AS Records,
    target_path_table, target_file, status FROM shown
"""
_LOG_CTE = f"WITH log AS ({_LOG_SQL.format(events='events')})"


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as large as ``events``, one row per event."""
    return spark.sql(_LOG_SQL.format(events="{events}"), events=table(spark, sf_dir, "events"))


@check(_LOG_CTE + _REPORT_SQL)
def runlog_latest_join(spark, sf_dir):
    return runlog.report(runlog.latest_rows(derived_log(spark, sf_dir), RUN_ID))


@check(_LOG_CTE + _REPORT_SQL)
def runlog_latest_window(spark, sf_dir):
    return runlog.report(runlog.latest_rows_window(derived_log(spark, sf_dir), RUN_ID))


@check(_LOG_CTE + """
SELECT * EXCLUDE (timestamp, n) FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline, run_id, service, task_order, operation
                               ORDER BY timestamp DESC, source_file_dml DESC) AS n FROM log) WHERE n = 1
""")
def runlog_current_state(spark, sf_dir):
    log = RunLog(spark, f"{shared_dir(spark, 'log')}/run_log")
    log.append_rows(derived_log(spark, sf_dir))
    return runlog.current_state(log.read(with_sequence=True)).drop("timestamp")


@check(_LOG_CTE + """
SELECT * EXCLUDE (timestamp, n) REPLACE (
  CASE WHEN run_id = 'run-3' AND operation = 'write' AND task_order = 7 THEN 'failed' ELSE status END AS status)
FROM (SELECT *, row_number() OVER (PARTITION BY pipeline, run_id, service, task_order, operation
                                   ORDER BY timestamp DESC, source_file_dml DESC) AS n FROM log) WHERE n = 1
""")
def runlog_status_update(spark, sf_dir):
    """A corrected status reaches one task's operation, not every write of the run."""
    log = RunLog(spark, f"{shared_dir(spark, 'log')}/run_log")
    log.append_rows(derived_log(spark, sf_dir))
    log.correct_status(RUN_ID, 7, "write", "failed")
    return runlog.current_state(log.read(with_sequence=True)).drop("timestamp")


@check(_LOG_CTE + """
SELECT pipeline, run_id, service, task_order, source_path_table, source_file_dml, record_count AS Records,
  target_path_table, target_file, CASE task_order WHEN 7 THEN 'failed' ELSE status END AS status
FROM log WHERE run_id = 'run-3'
QUALIFY row_number() OVER (PARTITION BY pipeline, service, task_order ORDER BY timestamp DESC, source_file_dml DESC) = 1
""")
def run_report_rows(spark, sf_dir):
    """The report of one run of a stored log of many. A correction counts, also where the log's clock is ahead."""
    log = RunLog(spark, f"{shared_dir(spark, 'log')}/run_log")
    ahead = F.col("timestamp") + F.expr("INTERVAL 100 YEARS")
    log.append_rows(derived_log(spark, sf_dir).withColumn("timestamp", ahead))
    log.correct_status(RUN_ID, 7, "write", "failed")
    return runlog.run_report(log.read(RUN_ID, with_sequence=True), RUN_ID)


# Transfers -----------------------------------------------------------------------------------------------------------


@check("SELECT * FROM orders")
def transfer_file_table(spark, sf_dir):
    orders, work, database = table(spark, sf_dir, "orders"), shared_dir(spark, "transfer"), new_database(spark)
    file_sinks.write_delimited(orders, f"{work}/orders_20240131.csv")
    transfer(
        new_context(spark, work), spec.FILE_TO_TABLE, source_s3_file_path=f"{work}/orders_yyyymmdd.csv",
        target_access_db="warehouse", target_table=f"{database}.orders", schema=ddl(orders),
    )
    return spark.table(f"{database}.orders")


@check("""
SELECT 'S3-DB' AS service, operation, count(*) AS record_count, 'success' AS status
FROM orders CROSS JOIN (VALUES ('read'), ('write')) AS o(operation) GROUP BY operation
""")
def transfer_counts(spark, sf_dir):
    orders, work, database = table(spark, sf_dir, "orders"), shared_dir(spark, "transfer"), new_database(spark)
    context = new_context(spark, work)
    file_sinks.write_parquet(orders, f"{work}/orders.parquet")
    transfer(
        context, spec.FILE_TO_TABLE, source_s3_file_path=f"{work}/orders.parquet",
        target_access_db="warehouse", target_table=f"{database}.orders",
    )
    return context.log.read().select("service", "operation", "record_count", "status")


@check("SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'")
def transfer_table_file(spark, sf_dir):
    database, work = _store(spark, sf_dir, "orders"), shared_dir(spark, "transfer")
    target = transfer(
        new_context(spark, work), spec.TABLE_TO_FILE, source_access_db="warehouse", source_table=f"{database}.orders",
        dml=f"SELECT * FROM {database}.orders WHERE o_orderpriority <> '1-URGENT'",
        target_s3_file_path=f"{work}/orders_yyyymmddHHMMSS.parquet",
    )
    return spark.read.parquet(target)


@check("SELECT * FROM lineitem")
def transfer_typed_by_target(spark, sf_dir):
    """An append that takes its types from the table, with no pass to infer them."""
    lineitem, work, database = table(spark, sf_dir, "lineitem"), shared_dir(spark, "transfer"), new_database(spark)
    table_sinks.load_table(lineitem.where("l_linenumber = 1"), WAREHOUSE, f"{database}.lineitem")
    file_sinks.write_delimited(lineitem.where("NOT (l_linenumber <=> 1)"), f"{work}/lineitem.txt", delimiter="\t")
    transfer(
        new_context(spark, work), spec.FILE_TO_TABLE, source_s3_file_path=f"{work}/lineitem.txt", file_delimiter="\t",
        target_access_db="warehouse", target_table=f"{database}.lineitem",
    )
    return spark.table(f"{database}.lineitem")


@check("SELECT * FROM customer")
def transfer_table_table(spark, sf_dir):
    database, work = _store(spark, sf_dir, "customer"), shared_dir(spark, "transfer")
    transfer(
        new_context(spark, work), spec.TABLE_TO_TABLE,
        source_access_db="warehouse", source_table=f"{database}.customer",
        target_access_db="warehouse", target_table=f"{database}.customer_copy", load_type="Overwrite",
    )
    return spark.table(f"{database}.customer_copy")


@check("SELECT * FROM part")
def transfer_file_file(spark, sf_dir):
    work = shared_dir(spark, "transfer")
    file_sinks.write_parquet(table(spark, sf_dir, "part"), f"{work}/from/part_20240131.parquet")
    target = transfer(
        new_context(spark, work), spec.FILE_TO_FILE, source_s3_file_path=f"{work}/from/part_yyyymmdd.parquet",
        target_s3_file_path=f"{work}/to/copy_yyyymmdd.parquet",
    )
    return spark.read.parquet(target)


@check("SELECT * FROM part")
def transfer_landing_file(spark, sf_dir):
    part, work = table(spark, sf_dir, "part"), shared_dir(spark, "transfer")
    file_sinks.write_delimited(part, f"{work}/landing/part_20240131053445.txt", delimiter="\t")
    target = transfer(
        new_context(spark, work), spec.LANDING_TO_FILE,
        source_sftp_file_path=f"{work}/landing/part_yyyymmddHHMMSS.txt",
        target_s3_file_path=f"{work}/in/part_yyyymmdd.csv",
    )
    return files.scan_delimited(spark, target, schema=part.schema)


@check("SELECT * FROM documents")
def transfer_landing_multiline(spark, sf_dir):
    """Texts with line ends, quotes and tabs go from tab to comma and stay whole."""
    documents, work = table(spark, sf_dir, "documents"), shared_dir(spark, "transfer")
    file_sinks.write_delimited(documents, f"{work}/landing/docs.txt", delimiter="\t", escape='"')
    target = transfer(
        new_context(spark, work), spec.LANDING_TO_FILE, source_sftp_file_path=f"{work}/landing/docs.txt",
        target_s3_file_path=f"{work}/in/docs_yyyymmdd.csv", csv_escape='"', csv_multiLine="true",
    )
    return files.scan_delimited(spark, target, schema=documents.schema, **RFC_QUOTES)


@check("SELECT * FROM conversations")
def transfer_tree(spark, sf_dir):
    """A directory tree, copied and read back with its folders as a column."""
    conversations, work = table(spark, sf_dir, "conversations"), shared_dir(spark, "transfer")
    conversations.write.partitionBy("role").parquet(f"{work}/from/chats")
    target = transfer(
        new_context(spark, work), spec.FILE_TO_FILE,
        source_s3_file_path=f"{work}/from/", target_s3_file_path=f"{work}/to/",
    )
    return spark.read.schema(conversations.schema).parquet(f"{target}chats").select(*conversations.columns)


@check("SELECT DISTINCT 'run-1' AS run_id, 0 AS task_order, 'k=' || o_orderkey % 1500 || '.csv' AS source_file FROM orders")
def directory_names(spark, sf_dir):
    """One row per file of a directory of up to 1500 files, as the load of that directory logs them."""
    orders, work, database = table(spark, sf_dir, "orders"), shared_dir(spark, "transfer"), new_database(spark)
    # A folder of parts with the name of a file counts as that file.
    named = orders.withColumn("k", F.concat((F.col("o_orderkey") % 1500).cast("string"), F.lit(".csv")))
    named.repartition("k").write.partitionBy("k").options(header=True, **file_sinks.LOSSLESS).csv(f"{work}/many")
    context = new_context(spark, work)
    transfer(
        context, spec.FILE_TO_TABLE, source_s3_file_path=f"{work}/many", target_access_db="warehouse",
        target_table=f"{database}.orders", schema=ddl(orders),
    )
    return context.log.read_source_files("run-1")


@check("""
SELECT 'S3-S3' AS service, 'copy' AS operation, count(DISTINCT (l_returnflag, l_linestatus)) AS objects FROM lineitem
""")
def copy_counts(spark, sf_dir):
    """Number of objects that the log has for a copied tree with one file a folder, without the writer's hidden files."""
    lineitem, work = table(spark, sf_dir, "lineitem"), shared_dir(spark, "transfer")
    keys = ["l_returnflag", "l_linestatus"]
    write_folders(lineitem.repartition(*keys), f"{work}/from/lines", *keys)
    context = new_context(spark, work)
    transfer(context, spec.FILE_TO_FILE, source_s3_file_path=f"{work}/from/", target_s3_file_path=f"{work}/to/")
    hidden = copying.list_tree(spark, f"{work}/to").where(F.col("relative").rlike(r"(^|/)[._][^/]*$")).count()
    objects = (F.col("record_count") - F.lit(hidden)).alias("objects")
    return context.log.read().select("service", "operation", objects)


@check("""
SELECT 'S3-DB' AS service, 0 AS task_order, count(*) AS Records, '' AS target_file, 'success' AS status FROM orders
UNION ALL SELECT 'DB-S3', 1, count(*), 'finished_20240201123030.csv', 'success' FROM orders WHERE o_orderstatus = 'F'
""")
def registered_run(spark, sf_dir):
    """From a filled form to the registry, from there to a run, and its report; the run's clock stamps the file."""
    orders, work, database = table(spark, sf_dir, "orders"), shared_dir(spark, "run"), new_database(spark)
    file_sinks.write_delimited(orders, f"{work}/orders_20240131.csv")
    loaded = f"{database}.orders"
    form = {
        "select_service_1": spec.FILE_TO_TABLE, "source_s3_file_path_1": f"{work}/orders_yyyymmdd.csv",
        "target_access_db_1": "warehouse", "target_table_1": loaded, "load_type_1": "Append", "schema_1": ddl(orders),
        "select_service_2": spec.TABLE_TO_FILE, "source_access_db_2": "warehouse", "source_table_2": loaded,
        "dml_2": f"SELECT * FROM {loaded} WHERE o_orderstatus = 'F'",
        "target_s3_file_path_2": f"{work}/out/finished_yyyymmddHHMMSS.csv",
    }
    pipelines = Registry(spark, f"{work}/registry")
    pipelines.append(spec.PipelineSpec.from_form("orders", form, "ops@example.org").to_row(spark))
    report = run_tasks(new_context(spark, work), spec.load_pipeline(pipelines.read(), "orders").tasks, on_failure="stop")
    return report.select("service", "task_order", "Records", "target_file", "status")


@check("SELECT * FROM events WHERE event_type = 'click'")
def ordered_run(spark, sf_dir):
    """Newest landed text file, to a stamped CSV, into a table, and a query on it to a stamped Parquet file."""
    events, work, database = table(spark, sf_dir, "events"), shared_dir(spark, "run"), new_database(spark)
    older = events.where("event_type = 'error'")
    file_sinks.write_delimited(older, f"{work}/landing/events_20240130235959.txt", delimiter="\t")
    file_sinks.write_delimited(events, f"{work}/landing/events_20240131053445.txt", delimiter="\t")
    loaded = f"{database}.events"
    tasks = [
        TaskSpec(spec.LANDING_TO_FILE, {
            "source_sftp_file_path": f"{work}/landing/events_yyyymmddHHMMSS.txt",
            "target_s3_file_path": f"{work}/received/events_yyyymmdd.csv"}),
        TaskSpec(spec.FILE_TO_TABLE, {
            "source_s3_file_path": f"{work}/received/events_yyyymmdd.csv", "header_row": "True", "load_type": "Append",
            "target_access_db": "warehouse", "target_table": loaded, "schema": ddl(events)}),
        TaskSpec(spec.TABLE_TO_FILE, {
            "source_access_db": "warehouse", "source_table": loaded,
            "dml": f"SELECT * FROM {loaded} WHERE event_type = 'click'",
            "target_s3_file_path": f"{work}/out/clicks_yyyymmddHHMMSS.parquet"}),
    ]
    run_tasks(new_context(spark, work), tasks, on_failure="stop")
    return files.scan_file(spark, f"{work}/out/clicks_yyyymmddHHMMSS.parquet").df


# Registry ------------------------------------------------------------------------------------------------------------

_TASKS_SQL = """
SELECT 'load_' || c_custkey AS pipeline_name, 0 AS task_order, 'SFTP to S3' AS service, c_name AS source FROM customer
UNION ALL SELECT 'load_' || c_custkey, 1, 'S3 to DB', c_mktsegment FROM customer
UNION ALL SELECT 'load_' || c_custkey, 2, 'S3 to DB', 'n' || c_nationkey FROM customer WHERE c_acctbal < 0
"""


def _pipelines(spark, sf_dir):
    def task(service, source):
        return F.struct(F.lit(service).alias("service"), F.create_map(F.lit("source"), source).alias("params"))

    recipients = F.concat(F.lit("ops@example.org, "), F.lower("c_mktsegment"), F.lit("@example.org,"))
    two = [task("SFTP to S3", F.col("c_name")), task("S3 to DB", F.col("c_mktsegment"))]
    third = task("S3 to DB", F.concat(F.lit("n"), "c_nationkey"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("load_"), "c_custkey").alias("pipeline_name"),
        recipients.alias("notification_recipients"),
        F.lit("0 0 * * *").alias("cron_schedule"),
        F.when(F.col("c_acctbal") < 0, F.array(*two, third)).otherwise(F.array(*two)).alias("services"),
    )


def _registered(spark, sf_dir):
    pipelines = Registry(spark, f"{shared_dir(spark, 'registry')}/pipelines")
    pipelines.append(_pipelines(spark, sf_dir))
    return pipelines.read()


@check(_TASKS_SQL)
def registry_tasks(spark, sf_dir):
    """Two tasks of one service stay two tasks."""
    rows = registry.task_rows(_registered(spark, sf_dir))
    return rows.select("pipeline_name", "task_order", "service", F.col("params")["source"].alias("source"))


@check("""
SELECT 'load_' || c_custkey AS pipeline_name, 'ops@example.org' AS recipient FROM customer
UNION ALL SELECT 'load_' || c_custkey, lower(c_mktsegment) || '@example.org' FROM customer
""")
def registry_recipients(spark, sf_dir):
    return registry.recipient_rows(_registered(spark, sf_dir))


@check("""
SELECT 'load_' || c_custkey AS pipeline_name, 0 AS task_order, 'S3 to DB' AS service, c_name AS source_table,
  ',' AS delimiter FROM customer
UNION ALL SELECT 'load_' || c_custkey, 9, 'DB to S3', c_mktsegment, '|' FROM customer
""")
def registry_form_tasks(spark, sf_dir):
    """Form rows with tasks 1 and 10; parameters go to their own task, and a blank delimiter is a comma."""
    def form(service, number, source, delimiter):
        keys = {"select_service": F.lit(service), "source_table": source, "file_delimiter": F.lit(delimiter)}
        return F.create_map(*(part for key, value in keys.items() for part in (F.lit(f"{key}_{number}"), value)))

    services = F.create_map(
        F.lit("S3 to DB"), form("S3 to DB", 1, F.col("c_name"), ""),
        F.lit("DB to S3"), form("DB to S3", 10, F.col("c_mktsegment"), "|"),
    )
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("load_"), "c_custkey").alias("pipeline_name"), F.to_json(services).alias("services")
    )
    tasks = registry.form_task_rows(rows)
    return tasks.select(
        "pipeline_name", "task_order", "service",
        params.param_by_prefix(F.col("params"), "source_table").alias("source_table"),
        naming.default_if_blank(F.col("params")["file_delimiter"], ",").alias("delimiter"),
    )


# Streaming -----------------------------------------------------------------------------------------------------------


@check("SELECT * FROM events")
def incremental_ingest(spark, sf_dir):
    """Two runs over a growing landing directory; each file's rows come in once."""
    events, work, database = table(spark, sf_dir, "events"), shared_dir(spark, "ingest"), new_database(spark)

    def run():
        stream = ingest.read_new_files(spark, f"{work}/landing/events_*.csv", events.schema)
        ingest.ingest_available(stream, f"{database}.events", f"{work}/checkpoint")

    even, odd = events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0").repartition(2)
    file_sinks.write_delimited(even, f"{work}/landing/events_20240130.csv")
    run()
    file_sinks.write_delimited(odd, f"{work}/landing/events_20240131.csv")
    run()
    return spark.table(f"{database}.events")


@check("SELECT *, event_id % 2 AS batch_id FROM events")
def incremental_database(spark, sf_dir):
    """The same through batches that are numbered in the target table."""
    events, work, database = table(spark, sf_dir, "events"), shared_dir(spark, "ingest"), new_database(spark)
    for odd in (0, 1):
        half = events.where(f"event_id % 2 = {odd}")
        file_sinks.write_delimited(half, f"{work}/landing/events_{odd}.csv")
        for _ in range(2):
            stream = ingest.read_new_files(spark, f"{work}/landing/*.csv", events.schema)
            ingest.ingest_available_to_database(stream, WAREHOUSE, f"{database}.events", f"{work}/checkpoint")
    return spark.table(f"{database}.events")


@check("""
SELECT *, CAST(0 AS BIGINT) AS batch FROM events WHERE event_id % 3 = 0
UNION ALL SELECT *, 1 FROM events WHERE event_id % 3 = 1 UNION ALL SELECT *, 2 FROM events WHERE event_id % 3 = 2
""")
def incremental_ledger(spark, sf_dir):
    """Three runs: a file, one whose stamp is older, and the first one replaced by other rows; each run twice."""
    events, work, database = table(spark, sf_dir, "events"), shared_dir(spark, "ingest"), new_database(spark)
    for third, day in enumerate(("20240131", "20240101", "20240131")):
        file_sinks.write_delimited(events.where(f"event_id % 3 = {third}"), f"{work}/landing/events_{day}.csv")
        for _ in range(2):
            ingest_new_files(
                Ledger(spark, f"{work}/ledger"), f"{work}/landing", "events_yyyymmdd.csv", events.schema, f"{database}.events")
    return spark.table(f"{database}.events")
