import types

import duckdb
import pytest
from helpers import same_rows

from portage.operators import exact_loads, table_sinks
from portage.operators.exact_loads import ExactLoad, load_exactly_once
from portage.plans import checks
from portage.session import stored
from portage.sources.tables import TableAccess

WAREHOUSE = TableAccess()


@pytest.fixture
def target(spark):
    return f"{checks.new_database(spark)}.t"


def test_each_load_once(spark, target):
    for _ in range(2):
        assert load_exactly_once(spark.range(50).repartition(4), WAREHOUSE, target, "monday") == 50
        assert load_exactly_once(spark.range(50, 60), WAREHOUSE, target, "it's tuesday") == 10
    same_rows(spark.table(target), spark.range(60))
    assert load_exactly_once(spark.range(0), WAREHOUSE, target, "nothing") == 0


def test_a_task_that_committed_and_ran_again(spark, target):
    spark.range(0).write.saveAsTable(target)
    load = ExactLoad(spark, WAREHOUSE, target, "a")
    load.stage(spark.range(40).repartition(4))
    staged = spark.table(load.staging)
    again = stored(staged.where("part = 2").withColumn("attempt", staged["attempt"] + 1000), "again")
    table_sinks.load_table(again, WAREHOUSE, load.staging)
    assert spark.table(load.staging).count() > 40
    assert load.finish() == 40
    same_rows(spark.table(target), spark.range(40))


@pytest.mark.parametrize("where", ["staged", "planned", "moved"])
def test_a_load_that_stops_is_carried_on(spark, target, monkeypatch, where):
    spark.range(100, 103).write.saveAsTable(target)
    with monkeypatch.context() as patch:
        if where == "staged":
            patch.setattr(ExactLoad, "finish", lambda self: 1 / 0)
        elif where == "planned":
            patch.setattr(ExactLoad, "_move", lambda self, count: 1 / 0)
        else:
            record = ExactLoad._record
            patch.setattr(ExactLoad, "_record", lambda self, state, *rest: 1 / 0 if state == "done" else record(self, state, *rest))
        with pytest.raises(ZeroDivisionError):
            load_exactly_once(spark.range(9), WAREHOUSE, target, "x")
    for _ in range(2):
        assert load_exactly_once(spark.range(9), WAREHOUSE, target, "x") == 9
    same_rows(spark.table(target), spark.range(9).union(spark.range(100, 103)))


def test_a_target_that_others_changed_meanwhile_is_left_alone(spark, target, monkeypatch):
    spark.range(3).write.saveAsTable(target)
    with monkeypatch.context() as patch:
        patch.setattr(ExactLoad, "_move", lambda self, count: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            load_exactly_once(spark.range(9), WAREHOUSE, target, "x")
    spark.range(1).write.insertInto(target)
    with pytest.raises(RuntimeError, match="has 4 rows"):
        load_exactly_once(spark.range(9), WAREHOUSE, target, "x")


def test_clashing_names(spark, target):
    with pytest.raises(ValueError, match="cannot be named Part"):
        load_exactly_once(spark.range(1).withColumnRenamed("id", "Part"), WAREHOUSE, target, "x")


def test_statements_of_a_database(spark, monkeypatch):
    """The text that a database gets, run by DuckDB: a part that was written twice, and an older try."""
    psql = TableAccess("PSQL", "db.example.org", "me", "secret")
    load = ExactLoad(spark, psql, "shop.main.t", "it's", "new")
    monkeypatch.setattr(ExactLoad, "_read", lambda self, table: types.SimpleNamespace(columns=["a", "b", *exact_loads.TAGS]))
    db = duckdb.connect()
    db.execute("CREATE TABLE t (a INT, b VARCHAR)")
    db.execute("CREATE TABLE t_loads (load_id VARCHAR, try_id VARCHAR, state VARCHAR, row_count BIGINT, rows_before BIGINT)")
    db.execute("CREATE TABLE t_staging (a INT, b VARCHAR, load_id VARCHAR, try_id VARCHAR, part BIGINT, attempt BIGINT)")
    rows = [(1, "x", 0, 7), (2, "y", 1, 8), (2, "y", 1, 9), (3, "z", 1, 8), (3, "z", 1, 9)]
    for try_id in ("new", "old"):
        db.executemany(f"INSERT INTO t_staging VALUES (?, ?, 'it''s', '{try_id}', ?, ?)", rows)
    db.execute("INSERT INTO t_staging VALUES (9, 'other', 'other', 'new', 0, 1)")
    for statement in load.move_statements(3):
        db.execute(statement)
    assert sorted(db.execute("SELECT * FROM t").fetchall()) == [(1, "x"), (2, "y"), (3, "z")]
    assert db.execute("SELECT * FROM t_loads").fetchall() == [("it's", "new", "done", 3, 0)]
    assert db.execute("SELECT a FROM t_staging").fetchall() == [(9,)]


def test_one_transaction(monkeypatch):
    told = []
    connection = types.SimpleNamespace(
        setAutoCommit=lambda on: told.append(("auto", on)), commit=lambda: told.append("commit"), close=lambda: told.append("close"),
        createStatement=lambda: types.SimpleNamespace(executeUpdate=lambda s: told.append(s) if s != "bad" else 1 / 0))
    java = types.SimpleNamespace(
        lang=types.SimpleNamespace(Class=types.SimpleNamespace(forName=lambda name: None)),
        sql=types.SimpleNamespace(DriverManager=types.SimpleNamespace(getConnection=lambda *login: told.append(login) or connection)))
    spark = types.SimpleNamespace(_jvm=types.SimpleNamespace(java=java))
    psql = TableAccess("PSQL", "db.example.org", "me", "secret")
    exact_loads._run_in_one_transaction(spark, psql, "shop.public.t", ["one", "two"])
    assert told[0][1:] == ("me", "secret") and told[1:] == [("auto", False), "one", "two", "commit", "close"]
    told.clear()
    with pytest.raises(ZeroDivisionError):
        exact_loads._run_in_one_transaction(spark, psql, "shop.public.t", ["one", "bad"])
    assert told[2:] == ["one", "close"]
