import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from portage.operators import runlog
from portage.operators.runlog import AuditRow, RunLog
from portage.plans import checks
from portage.sources.tables import TableAccess


def row(task_order, operation, service="S3-DB", run_id="r", status="success", count=1):
    return AuditRow("p", run_id, service, task_order, "src", "in/x", "it's.csv", operation, count, "tgt", "t", "", status)


@pytest.mark.parametrize("place", ["folder", "table"])
def test_rows_are_typed(spark, tmp_path, place):
    log = RunLog(spark, f"{tmp_path}/log")
    if place == "table":
        log = RunLog(spark, access=TableAccess(), table=f"{checks.new_database(spark)}.run_log")
    assert log.read().isEmpty()
    log.append(row(10, "read"), at=datetime(2024, 2, 1, 12, 30, 30))
    stored = log.read()
    assert stored.columns == runlog.COLUMNS
    first = stored.first()
    assert (first.task_order, first.source_file_dml, first.timestamp) == (10, "it's.csv", datetime(2024, 2, 1, 12, 30, 30))


def test_run_id_stays_text(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log")
    for run_id in ("007", "manual__2024-10-11T05:34:45+00:00"):
        log.append(row(0, "read", run_id=run_id))
    assert {r.run_id for r in log.read().collect()} == {"007", "manual__2024-10-11T05:34:45+00:00"}


def test_report_reads_only_its_run(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log")
    log.append(row(0, "read", run_id="a"))
    log.append(row(0, "read", run_id="b"))
    scanned = log.read().where("run_id = 'a'").select(F.input_file_name()).distinct().collect()
    assert len(scanned) == 1 and "run_id=a" in scanned[0][0]


def test_window_and_join_agree(spark, sf_dir):
    log = checks.derived_log(spark, sf_dir)
    same_rows(
        runlog.latest_rows(log, "run-3", match_service=True).select(*runlog.COLUMNS),
        runlog.latest_rows_window(log, "run-3").select(*runlog.COLUMNS),
    )


def test_equal_times_and_services(spark, tmp_path):
    """The plain join keeps ties and mixes services; the run report has one row per task."""
    log = RunLog(spark, f"{tmp_path}/log")
    clock = datetime(2024, 2, 1)
    log.append(row(0, "read"), row(0, "write"), row(0, "read", service="DB-DB"), at=clock)
    assert runlog.latest_rows(log.read(), "r").count() == 6
    assert runlog.latest_rows(log.read(), "r", match_service=True).count() == 3
    assert runlog.latest_rows_window(log.read(), "r").count() == 3
    report = runlog.run_report(log.read(), "r")
    assert report.count() == 2
    assert report.columns == [
        "pipeline", "run_id", "service", "task_order", "source_path_table", "source_file_dml", "Records",
        "target_path_table", "target_file", "status"]


def test_tasks_sort_as_numbers(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log")
    log.append(*(row(order, "copy") for order in (10, 2, 1)))
    assert [r.task_order for r in runlog.run_report(log.read(), "r").collect()] == [1, 2, 10]


def test_status_correction_reaches_one_operation_of_one_task(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log")
    log.append(*(row(order, operation) for order in (0, 1) for operation in ("read", "write")), at=datetime(2024, 2, 1))
    log.correct_status("r", 1, "write", "failed")
    state = {(r.task_order, r.operation): r.status for r in runlog.current_state(log.read()).collect()}
    assert state == {(0, "read"): "success", (0, "write"): "success", (1, "read"): "success", (1, "write"): "failed"}
    assert [r.status for r in runlog.run_report(log.read(), "r").collect()] == ["success", "failed"]
    assert log.read().count() == 5


@pytest.mark.parametrize("place", ["folder", "table"])
def test_of_equal_times_the_row_that_came_last_counts(spark, tmp_path, place):
    """Whatever the file names and the alphabet of the statuses say."""
    log = RunLog(spark, f"{tmp_path}/log")
    if place == "table":
        log = RunLog(spark, access=TableAccess(), table=f"{checks.new_database(spark)}.run_log")
    clock = datetime(2024, 2, 1)
    log.append(row(0, "write", status="success", count=9), row(1, "write", status="failed"), at=clock)
    log.append(row(0, "write", status="failed", count=1), row(1, "write", status="success"), at=clock)
    rows = log.read(with_sequence=True)
    assert [r.status for r in runlog.current_state(rows).orderBy("task_order").collect()] == ["failed", "success"]
    assert [r.status for r in runlog.run_report(rows, "r").collect()] == ["failed", "success"]
    log.correct_status("r", 1, "write", "failed")
    assert [r.status for r in runlog.current_state(log.read(with_sequence=True)).orderBy("task_order").collect()] == ["failed"] * 2


def test_newest_rows_are_chosen_before_the_shuffle(spark, sf_dir):
    plan = runlog.current_state(checks.derived_log(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange", 1)[1] and plan.count("Exchange") == 1


def test_logs_that_have_no_sequence(spark, tmp_path):
    """A folder and a table of an earlier version are read and go on."""
    plain = spark.createDataFrame([("p", "r", "S3-DB", 0, "s", "x", "f", "read", 1, "t", "y", "", "success", datetime(2024, 1, 1))], runlog.SCHEMA)
    plain.write.partitionBy("run_id").parquet(f"{tmp_path}/log")
    name = f"{checks.new_database(spark)}.run_log"
    plain.write.saveAsTable(name)
    for log in (RunLog(spark, f"{tmp_path}/log"), RunLog(spark, access=TableAccess(), table=name)):
        log.append(row(1, "write"))
        assert runlog.run_report(log.read(with_sequence=True), "r").count() == 2


def test_compaction_keeps_every_row(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log")
    for i in range(5):
        log.append(row(i, "copy", run_id="a"))
    log.append(row(9, "copy", run_id="b"))
    before = sorted(map(repr, log.read(with_sequence=True).collect()))
    log.compact("a")
    assert sorted(map(repr, log.read(with_sequence=True).collect())) == before
    assert len([name for name in os.listdir(tmp_path / "log" / "run_id=a") if name.endswith(".parquet")]) == 1
    assert sorted(name for name in os.listdir(tmp_path / "log") if name[0] != ".") == ["run_id=a", "run_id=b"]


def test_runs_at_the_same_time_do_not_lose_rows(spark, tmp_path):
    """Appends of several runs that overlap; also a slow job that writes to the same folder."""
    log = RunLog(spark, f"{tmp_path}/log")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: log.append(row(i, "copy", run_id=f"r{i % 3}")), range(24)))
    assert sorted(r.task_order for r in log.read().collect()) == list(range(24))
    assert sorted(name for name in os.listdir(tmp_path / "log") if name[0] not in "._") == ["run_id=r0", "run_id=r1", "run_id=r2"]
    assert not [name for name in os.listdir(tmp_path / "log") if name.startswith("_append")]
