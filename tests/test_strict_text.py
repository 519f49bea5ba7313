"""Text that does not fit its schema or header is an error, never a lost or misplaced value."""

import os
import time

import pytest
from helpers import put

from portage.operators.runlog import RunLog
from portage.sources import files
from portage.streaming import ingest


@pytest.mark.parametrize("line", ["12x,3", "4,5,6", "7"])
def test_lines_that_do_not_fit_are_refused(spark, tmp_path, line):
    path = str(put(tmp_path / "n.csv", f"a,b\n{line}\n"))
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_file(spark, path, schema="a int, b int").df.collect()
    tolerant = files.scan_file(spark, path, schema="a int, b int", mode="PERMISSIVE").df
    assert tolerant.count() == 1


def test_landing_lines_with_more_values_are_refused(spark, tmp_path):
    path = str(put(tmp_path / "n.txt", "a\tb\n1\t2\n3\t4\t5\n"))
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_raw(spark, path, header=True).collect()


def test_columns_in_another_order_are_never_misplaced(spark, tmp_path):
    """A directory is read by its header lines; one file with a schema in another order, or a stream, is refused."""
    put(tmp_path / "in" / "x.csv", "a,b\n1,2\n")
    put(tmp_path / "in" / "y.csv", "b,a\n2,1\n")
    rows = files.scan_file(spark, str(tmp_path / "in"), schema="a int, b int").df.collect()
    assert [(row.a, row.b) for row in rows] == [(1, 2), (1, 2)]
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_file(spark, str(tmp_path / "in" / "y.csv"), schema="a int, b int").df.collect()
    stream = ingest.read_new_files(spark, f"{tmp_path}/in/*.csv", "a int, b int")
    with pytest.raises(Exception, match="(?i)header|FAILED_READ_FILE"):
        ingest.ingest_available(stream, "strict_order", f"{tmp_path}/checkpoint")


def test_old_files_are_new_until_they_are_read(spark, tmp_path):
    def run():
        stream = ingest.read_new_files(spark, f"{tmp_path}/in/*.csv", "a int")
        ingest.ingest_available(stream, "late_files", f"{tmp_path}/checkpoint")

    put(tmp_path / "in" / "x1.csv", "a\n1\n")
    run()
    late = put(tmp_path / "in" / "x2.csv", "a\n2\n")
    month_ago = time.time() - 30 * 86400
    os.utime(late, (month_ago, month_ago))
    run()
    assert sorted(row.a for row in spark.table("late_files").collect()) == [1, 2]


def test_a_correction_is_later_than_a_clock_ahead(spark, tmp_path):
    log = RunLog(spark, f"file:{tmp_path}/log")
    spark.sql(
        "SELECT 'p' AS pipeline, 'r' AS run_id, 'DB-DB' AS service, 0 AS task_order, 'a' AS source_access, 's' AS source_path_table, "
        "'f' AS source_file_dml, 'write' AS operation, 1L AS record_count, 'b' AS target_access, 't' AS target_path_table, "
        "'o' AS target_file, 'success' AS status, TIMESTAMP '2090-01-01 00:00:00' AS timestamp"
    ).createOrReplaceTempView("ahead")
    log.append_rows(spark.table("ahead"))
    log.correct_status("r", 0, "write", "failed")
    assert log.read().orderBy("timestamp").collect()[-1].status == "failed"
