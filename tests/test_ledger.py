import os

import pytest
from helpers import put

from portage.plans import checks
from portage.streaming import ledger as ledgers
from portage.streaming.ledger import Ledger, ingest_new_files


@pytest.fixture
def place(spark, tmp_path):
    return Ledger(spark, f"{tmp_path}/ledger"), str(tmp_path / "in"), f"{checks.new_database(spark)}.t"


def rows(spark, table):
    return sorted(tuple(r) for r in spark.table(table).collect())


def load(place, **options):
    return ingest_new_files(place[0], place[1], "x_yyyymmdd.csv", "a int, b string", place[2], **options)


def test_old_and_replaced_files_over_three_rounds(spark, tmp_path, place):
    put(tmp_path / "in/x_20240102.csv", "a,b\n1,v\n")
    put(tmp_path / "in/other_20240102.csv", "a,b\n9,v\n")
    put(tmp_path / "in/x_20249999.csv", "a,b\n9,v\n")
    assert (load(place), load(place)) == (1, 0)
    old = put(tmp_path / "in/x_20240101.csv", "a,b\n2,v\n")
    os.utime(old, (10**9, 10**9))  # long before the newest file that was taken
    assert (load(place), load(place)) == (1, 0)
    put(tmp_path / "in/x_20240102.csv", "a,b\n1,v\n3,new\n")
    assert (load(place), load(place)) == (1, 0)
    assert rows(spark, place[2]) == [(1, "v", 0), (1, "v", 2), (2, "v", 1), (3, "new", 2)]


def test_batches_of_bounded_size_and_a_compacted_ledger(spark, tmp_path, place, monkeypatch):
    monkeypatch.setattr(ledgers, "COMPACT_AFTER", 3)
    for i in range(11):
        put(tmp_path / f"in/x_202401{i + 10}.csv", f"a,b\n{i},v\n")
    assert load(place, most_files=2) == 6 and load(place, most_files=2) == 0
    assert [r[0] for r in rows(spark, place[2])] == list(range(11))
    assert spark.table(place[2]).groupBy("batch").count().where("count > 2").isEmpty()
    assert len([name for name in os.listdir(tmp_path / "ledger/files") if name.startswith("batch=")]) == 1
    assert place[0].files().select("path").distinct().count() == 11
    put(tmp_path / "in/x_20240201.csv", "a,b\n99,v\n")
    assert load(place) == 1 and len(rows(spark, place[2])) == 12


@pytest.mark.parametrize("where", ["before the load", "in the load", "after the load"])
def test_a_run_that_stops_is_carried_on(spark, tmp_path, place, monkeypatch, where):
    """Files that came meanwhile are left to the next batch."""
    put(tmp_path / "in/x_20240101.csv", "a,b\n1,v\n")
    load(place)
    put(tmp_path / "in/x_20240102.csv", "a,b\n2,v\n" if where != "in the load" else "a,b\n2,v\nbad,v\n")
    with monkeypatch.context() as patch:
        if where == "before the load":
            patch.setattr(ledgers, "_load", lambda *_: 1 / 0)
        elif where == "after the load":
            patch.setattr(Ledger, "finish", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            load(place)
    put(tmp_path / "in/x_20240103.csv", "a,b\n3,v\n")
    put(tmp_path / "in/x_20240102.csv", "a,b\n2,v\n") if where == "in the load" else None
    load(place)
    found = rows(spark, place[2])
    # A mended file has changed since it was planned: it is loaded as it is now, and once more as a new file.
    assert found == sorted([(1, "v", 0), (2, "v", 1), (3, "v", 2)] + [(2, "v", 2)] * (where == "in the load"))


def test_no_files(spark, place):
    assert load(place) == 0 and not spark.catalog.tableExists(place[2])


def test_names_by_expression_and_folders_of_parts(spark, tmp_path, place):
    checks.file_sinks.write_delimited(spark.range(6).repartition(3), f"{tmp_path}/in/a.csv")
    put(tmp_path / "in/b.csv", "id\n7\n")
    put(tmp_path / "in/b.csv.bak", "id\n8\n")
    assert ingest_new_files(place[0], place[1], r"[ab]\.csv", "id bigint", place[2]) == 1
    assert [r[0] for r in rows(spark, place[2])] == [0, 1, 2, 3, 4, 5, 7]
