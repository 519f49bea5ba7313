"""Each registered query against its SQL, as multisets of rows."""

import glob
import os

import duckdb
import pytest
from helpers import same_rows

import __spark_entry__ as driver
from portage.plans.checks import CHECKS

SQL = {name: check.sql for name, check in CHECKS.items()}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows(table, columns):
    return sorted((tuple(row[c] for c in columns) for row in table.select(columns).to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    actual = driver.queries()[name](spark, sf_dir).toArrow()
    expected = oracle.execute(SQL[name]).to_arrow_table()
    columns = sorted(expected.column_names)
    assert sorted(actual.column_names) == columns
    assert [str(actual.schema.field(c).type) for c in columns] == [str(expected.schema.field(c).type) for c in columns]
    assert rows(actual, columns) == rows(expected, columns)
    assert actual.num_rows > 0


def test_one_file_holds_every_event(spark, tmp_path):
    """Each row comes back, repeats and nulls included, and the SQL asks for all of them."""
    values = [(1, "2024-01-01 00:00:07.179575", "click", 0.5, '{"k": 1, "q": "a,b"}'), (2, "2024-01-01 09:00:00", "click", 2.0, None)]
    rows = [*values, *values, (3, None, None, None, " x "), (None, "2024-01-02 00:00:00", "view", -1.0, "y")]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double, props string")
    events.withColumn("ts", events.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    single = CHECKS["publish_single"]
    same_rows(single.query(spark, str(tmp_path)), spark.read.parquet(f"{tmp_path}/events.parquet"))
    view = f"WITH events AS (FROM read_parquet('{tmp_path}/events.parquet/*.parquet')) "
    assert len(duckdb.sql(view + single.sql).fetchall()) == len(rows)


def test_checks_are_registered():
    assert set(CHECKS) <= set(driver.queries()) and set(CHECKS) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
