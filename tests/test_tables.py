"""JDBC settings are checked as options, since no database is at hand; loads are checked on catalog tables."""

from datetime import datetime

import duckdb
import pytest
from helpers import same_rows
from pyspark.sql.classic.dataframe import DataFrame

from portage.operators import table_sinks
from portage.plans import checks
from portage.plans import spec, transfers
from portage.plans.spec import TaskSpec
from portage.sources import tables
from portage.sources.tables import Partitioning, TableAccess

MYSQL = TableAccess("MySQL", "db.example.org", "me", "secret")
PSQL = TableAccess("PSQL", "db.example.org", "me", "secret", port=6543, options={"fetchsize": "50"})


def test_each_kind_of_database_has_its_own_driver_and_url():
    mysql = tables.connection_options(MYSQL, "shop.orders")
    assert mysql["url"].startswith("jdbc:mysql://db.example.org:3306/shop?") and mysql["driver"] == "com.mysql.cj.jdbc.Driver"
    psql = tables.connection_options(PSQL, "shop.public.orders")
    assert psql["url"].startswith("jdbc:postgresql://db.example.org:6543/shop?")
    assert psql["driver"] == "org.postgresql.Driver" and psql["fetchsize"] == "50"


def test_targets_have_no_database_in_their_name():
    assert table_sinks.writer_options(MYSQL, "shop.orders")["dbtable"] == "orders"
    assert table_sinks.writer_options(PSQL, "shop.public.orders")["dbtable"] == "public.orders"


def test_writer_options():
    options = table_sinks.writer_options(MYSQL, "shop.orders", True, 4, 500, "name VARCHAR(80)")
    assert options["truncate"] == "true" and options["numPartitions"] == "4" and options["batchsize"] == "500"
    assert options["createTableColumnTypes"] == "name VARCHAR(80)"
    assert "numPartitions" not in table_sinks.writer_options(MYSQL, "shop.orders")


@pytest.mark.parametrize("dialect, name", [("MySQL", "orders"), ("PSQL", "shop.orders"), ("MySQL", "a.b.c"), ("MySQL", "a.")])
def test_incomplete_table_names_are_refused(dialect, name):
    with pytest.raises(ValueError):
        tables.split_table_name(dialect, name)


def test_query_text():
    assert tables.query_text("shop.orders") == "( SELECT * FROM shop.orders ) AS query"
    assert tables.query_text("shop.orders", " SELECT 1; ") == "( SELECT 1 ) AS query"


def test_range_options():
    assert tables.range_options(Partitioning("id", 8), 1, 99) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "99", "numPartitions": "8",
    }


def test_password_is_not_shown():
    assert "secret" not in repr(MYSQL)


def test_only_queries_run_as_dml(spark, sf_dir):
    database = checks._store(spark, sf_dir, "region")
    with pytest.raises(Exception):
        tables.scan_table(spark, TableAccess(), f"{database}.region", f"DROP TABLE {database}.region")
    assert spark.catalog.tableExists(f"{database}.region")


def test_append_matches_columns_by_name(spark):
    target = f"{checks.new_database(spark)}.t"
    table_sinks.load_table(spark.sql("SELECT 1 AS a, 2 AS b"), TableAccess(), target)
    assert table_sinks.load_table(spark.sql("SELECT 20 AS b, 10 AS a"), TableAccess(), target) == 1
    same_rows(spark.table(target), spark.createDataFrame([(1, 2), (10, 20)], "a int, b int"))


def test_append_with_other_columns_is_refused(spark):
    target = f"{checks.new_database(spark)}.t"
    table_sinks.load_table(spark.sql("SELECT 1 AS a"), TableAccess(), target)
    with pytest.raises(Exception):
        table_sinks.load_table(spark.sql("SELECT 1 AS z"), TableAccess(), target)


@pytest.mark.parametrize("truncate", [True, False])
def test_overwrite(spark, truncate):
    target = f"{checks.new_database(spark)}.t"
    table_sinks.load_table(spark.range(5), TableAccess(), target, "Overwrite", truncate)
    assert table_sinks.load_table(spark.range(3), TableAccess(), target, "Overwrite", truncate) == 3
    same_rows(spark.table(target), spark.range(3))


def test_load_types():
    assert (table_sinks.load_mode("Append"), table_sinks.load_mode("Overwrite"), table_sinks.load_mode("")) == (
        "append", "overwrite", "append")
    with pytest.raises(ValueError):
        table_sinks.load_mode("Merge")


class Recorder:
    """Stands in for a reader or writer: keeps what it is told, and answers with a given frame."""

    def __init__(self, answers=()):
        self.calls, self.answers = [], list(answers)

    @property
    def read(self):
        self.told = {}
        return self

    def format(self, name):
        self.told["format"] = name
        return self

    def mode(self, name):
        self.told["mode"] = name
        return self

    def options(self, **options):
        self.told.update(options)
        return self

    def load(self):
        self.calls.append(self.told)
        return self.answers.pop(0) if self.answers else None

    def jdbc(self, url, relation, predicates, properties):
        self.calls.append({"url": url, "dbtable": relation, "predicates": predicates, **properties})


def test_jdbc_scan_of_a_table_and_of_a_query():
    spark = Recorder()
    tables.scan_table(spark, PSQL, "shop.public.orders")
    tables.scan_table(spark, MYSQL, "shop.orders", "SELECT a FROM shop.orders;")
    assert [(c["format"], c["dbtable"]) for c in spark.calls] == [
        ("jdbc", "( SELECT * FROM shop.public.orders ) AS query"), ("jdbc", "( SELECT a FROM shop.orders ) AS query")]
    assert "partitionColumn" not in spark.calls[0]


def test_jdbc_scan_by_ranges_asks_for_missing_bounds(spark):
    bounds = spark.createDataFrame([(5, 90)], "lo int, hi int")
    recorder = Recorder([bounds])
    tables.scan_table(recorder, PSQL, "shop.public.orders", partitioning=Partitioning("id", 8, upper="100"))
    asked, read = recorder.calls
    assert asked["dbtable"] == (
        "( SELECT MIN(id) AS lo, MAX(id) AS hi FROM ( SELECT * FROM shop.public.orders ) AS query ) AS bounds")
    assert (read["partitionColumn"], read["lowerBound"], read["upperBound"], read["numPartitions"]) == ("id", "5", "100", "8")


def test_jdbc_scan_by_ranges_of_an_empty_table(spark):
    recorder = Recorder([spark.createDataFrame([(None, None)], "lo int, hi int")])
    tables.scan_table(recorder, PSQL, "shop.public.orders", partitioning=Partitioning("id", 8))
    assert "partitionColumn" not in recorder.calls[1]


def test_jdbc_scan_by_predicates():
    recorder = Recorder()
    parts = ("id < 10", "id >= 10 OR id IS NULL")
    tables.scan_table(recorder, MYSQL, "shop.orders", partitioning=Partitioning(predicates=parts))
    assert recorder.calls[0]["predicates"] == list(parts) and recorder.calls[0]["user"] == "me"


@pytest.mark.parametrize("load_type, mode", [("Append", "append"), ("Overwrite", "overwrite")])
def test_jdbc_load(spark, monkeypatch, load_type, mode):
    """What the JDBC sink is told; the rows go to a sink that drops them, and are counted on the way."""

    class Writer(Recorder):
        def save(self):
            self.calls.append(self.told)
            plain_write(self.frame).format("noop").mode("overwrite").save()

    writer, plain_write = Writer(), DataFrame.write.fget

    def write(frame):
        writer.told, writer.frame = {}, frame
        return writer

    monkeypatch.setattr(DataFrame, "write", property(write))
    rows = table_sinks.load_table(spark.range(11), PSQL, "shop.public.orders", load_type, truncate=True, batch_size=7)
    (told,) = writer.calls
    assert rows == 11 and told["format"] == "jdbc" and told["mode"] == mode and told["dbtable"] == "public.orders"
    assert told["batchsize"] == "7" and told["truncate"] == "true"


def test_tables_are_looked_up_in_their_schema(spark):
    recorder = Recorder([spark.createDataFrame([(1,)], "found int"), spark.createDataFrame([(0,)], "found int")])
    assert tables.table_exists(recorder, PSQL, "shop.public.orders")
    assert not tables.table_exists(recorder, MYSQL, "shop.orders")
    assert "table_schema = 'public' AND table_name = 'orders'" in recorder.calls[0]["dbtable"]
    assert "table_schema = 'shop' AND table_name = 'orders'" in recorder.calls[1]["dbtable"]


@pytest.mark.parametrize("table, column", [("orders", "o_orderkey"), ("orders", "o_orderdate"), ("lineitem", "l_linenumber")])
def test_even_ranges_hold_every_row_once(sf_dir, table, column):
    """The text that a database gets, run by DuckDB: with few distinct values, and with rows that have none."""
    relation = f"( SELECT NULLIF({column}, MAX({column}) OVER ()) AS {column} FROM '{sf_dir}/{table}.parquet' ) AS query"
    bounds = duckdb.sql(f"SELECT lo FROM {tables.even_bounds_query(relation, column, 8)}").fetchall()
    predicates = tables.even_predicates(column, [low for (low,) in bounds])
    tests = ", ".join(f"CASE WHEN {predicate} THEN 1 ELSE 0 END" for predicate in predicates)
    hits = duckdb.sql(f"SELECT DISTINCT list_sum([{tests}]) FROM {relation}").fetchall()
    assert hits == [(1,)] and 1 < len(predicates) <= 8
    if column == "o_orderkey":
        counts = duckdb.sql("SELECT " + ", ".join(f"COUNT(*) FILTER ({p})" for p in predicates) + f" FROM {relation}").fetchall()[0]
        assert max(counts) - min(counts) <= 2


def test_even_predicates_of_few_values():
    assert tables.even_predicates("k", []) == tables.even_predicates("k", [3, 3]) == ["1 = 1"]
    assert tables.even_predicates("t", [datetime(2024, 1, 2), datetime(2024, 1, 1)]) == [
        "(t < '2024-01-02 00:00:00' OR t IS NULL)", "t >= '2024-01-02 00:00:00'"]


def test_jdbc_scan_by_even_ranges(spark):
    recorder = Recorder([spark.createDataFrame([(5,), (1,)], "lo int")])
    tables.scan_table(recorder, PSQL, "shop.public.orders", partitioning=Partitioning("id", 2, even=True))
    assert recorder.calls[1]["predicates"] == ["(id < 5 OR id IS NULL)", "id >= 5"]
    with pytest.raises(ValueError):
        texts = Recorder([spark.createDataFrame([("a",)], "lo string")])
        tables.scan_table(texts, PSQL, "shop.public.orders", partitioning=Partitioning("name", 2, even=True))


HOT = (
    "( SELECT CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 90 "
    "ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS c FROM '{}/orders.parquet' ) AS query"
)


@pytest.mark.parametrize("second", ["", "c"])
@pytest.mark.parametrize("share_of_rows", [1, 7])
@pytest.mark.parametrize("parts", [1, 4, 16])
def test_sampled_predicates_hold_every_row_once(sf_dir, parts, share_of_rows, second):
    """Values that a third of the rows repeat, nulls in both columns, and rows that the sample doesn't have."""
    relation = HOT.format(sf_dir)
    partitioning = Partitioning("k", parts, sampled=True, second_column=second)
    sample = duckdb.sql(
        f"SELECT k, {second or 'NULL'} FROM {relation} WHERE k IS NOT NULL AND coalesce(c, 0) % {share_of_rows} = 0").fetchall()
    predicates = tables.depth_predicates(partitioning, sample)
    tests = ", ".join(f"CASE WHEN {predicate} THEN 1 ELSE 0 END" for predicate in predicates)
    assert duckdb.sql(f"SELECT DISTINCT list_sum([{tests}]) FROM {relation}").fetchall() == [(1,)]
    counts = duckdb.sql("SELECT " + ", ".join(f"COUNT(*) FILTER ({p})" for p in predicates) + f" FROM {relation}").fetchall()[0]
    if parts == 16 and share_of_rows == 1:
        rows = sum(counts)
        assert max(counts) < rows / (5 if second else 2.5) and len(predicates) <= 2 * parts


def test_sampled_predicates_of_odd_samples():
    one = Partitioning("k", 4, sampled=True)
    assert tables.depth_predicates(one, []) == ["1 = 1"]
    assert tables.depth_predicates(one, [(float("nan"), None)]) == ["1 = 1"]
    days = [(datetime(2024, 1, day), None) for day in (1, 2, 3, 4)]
    assert tables.depth_predicates(Partitioning("t", 2, sampled=True), days) == [
        "((t < '2024-01-03 00:00:00' OR t IS NULL))", "(t >= '2024-01-03 00:00:00')"]


def test_jdbc_scan_by_a_sample(spark, caplog):
    total, sample = spark.createDataFrame([(10**6,)], "n long"), spark.createDataFrame([(1, 5), (1, 6), (2, None), (3, 1)], "v int, w int")
    recorder = Recorder([total, sample])
    wanted = Partitioning("id", 2, sampled=True, second_column="day")
    tables.scan_table(recorder, PSQL, "shop.public.orders", partitioning=wanted)
    counted, asked, read = recorder.calls
    assert "COUNT(*)" in counted["dbtable"] and "RANDOM() < 0.020000000000" in asked["dbtable"] and "LIMIT 40000" in asked["dbtable"]
    assert read["predicates"] == tables.depth_predicates(wanted, [(1, 5), (1, 6), (2, None), (3, 1)])
    with pytest.raises(ValueError, match="text"):
        texts = Recorder([total, spark.createDataFrame([("a",)], "v string")])
        tables.scan_table(texts, PSQL, "shop.public.orders", partitioning=Partitioning("name", 2, sampled=True))
    caplog.clear()
    tables.scan_table(Recorder(), PSQL, "shop.public.orders", single_connection=True)
    assert not caplog.records
    tables.scan_table(Recorder(), PSQL, "shop.public.orders")
    assert "one connection" in caplog.text


def test_partitioning_of_a_task():
    def of(**params):
        return transfers._partitioning(TaskSpec(spec.TABLE_TO_FILE, params))

    assert of() is None
    assert of(predicates='["k < 1", "k >= 1"]') == Partitioning(predicates=("k < 1", "k >= 1"))
    assert of(partition_column="k", num_partitions="3", partition_sampled="true", partition_second_column="c") == Partitioning(
        "k", 3, sampled=True, second_column="c")
