"""Each corpus query that SQL can express against its SQL."""

import duckdb
import pytest

from portage.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "benchmark", "pages", "conversations", "embeddings")


def rows(table, columns):
    return sorted((tuple(row[c] for c in columns) for row in table.select(columns).to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    expected = connection.sql(ORACLE_SQL[name]).to_arrow_table()
    actual = QUERIES[name](spark, sf_dir).toArrow()
    columns = sorted(expected.column_names)
    assert sorted(actual.column_names) == columns
    assert rows(actual, columns) == rows(expected, columns)
