import pytest
from helpers import audit, context, put, run
from pyspark.errors import PySparkException

from portage.operators import counting, rejects
from portage.plans import spec
from portage.sources import files

LINES = 'k,v\n1,a\n2,b,c\nx,d\n3\n4,"e,f"\n,g\n'


def split(spark, path, **options):
    return rejects.split_rejects(files.scan_with_rejects(spark, str(path), schema="k int, v string", **options))


def test_lines_that_do_not_fit_are_kept_as_they_are(spark, tmp_path):
    found = split(spark, put(tmp_path / "n.csv", LINES))
    assert sorted((tuple(r) for r in found.good.collect()), key=repr) == [(1, "a"), (4, "e,f"), (None, "g")]
    assert sorted(r.line for r in found.rejected.collect()) == ["2,b,c", "3", "x,d"]
    assert (found.good_rows, found.rejected_rows) == (3, 3)
    assert {r.source_file.removeprefix("file:").lstrip("/") for r in found.rejected.collect()} == {f"{tmp_path}/n.csv".lstrip("/")}


@pytest.mark.parametrize("text, numbers", [("k,v\n", (0, 0)), ("", (0, 0)), ("k,v\n1,a\n", (1, 0)), ("k,v\n1\n2\n", (0, 2))])
def test_sides_without_rows(spark, tmp_path, text, numbers):
    found = split(spark, put(tmp_path / "n.csv", text))
    assert (found.good_rows, found.rejected_rows) == numbers
    assert (found.good.count(), found.rejected.count()) == numbers and found.good.columns == ["k", "v"]


def test_headers_are_still_checked_and_names_must_not_clash(spark, tmp_path):
    with pytest.raises(Exception, match="header"):
        split(spark, put(tmp_path / "n.csv", "k,other\n1,a\n"))
    with pytest.raises(ValueError, match="rejected_line"):
        files.scan_with_rejects(spark, str(tmp_path), schema="Rejected_Line int")


def test_load_goes_on_and_counts_what_it_rejects(spark, tmp_path):
    ctx = context(spark, tmp_path)
    spark.sql("DROP TABLE IF EXISTS rejects_target")
    put(tmp_path / "n_20240101.csv", LINES)
    for task_order in (0, 0, 1):  # a task that runs again replaces its lines
        result = run(ctx, spec.FILE_TO_TABLE, task_order, source_s3_file_path=f"{tmp_path}/n_yyyymmdd.csv", schema="k int, v string",
                     target_access_db="warehouse", target_table="rejects_target", load_type="Overwrite",
                     on_bad_lines="reject", rejects_path=f"{tmp_path}/rejects")
        assert result.ok and result.records == 3
    kept = spark.read.parquet(f"{tmp_path}/rejects")
    assert sorted((r.run_id, r.task_order, r.line) for r in kept.collect()) == sorted(
        ("run-1", n, line) for n in (0, 1) for line in ("2,b,c", "3", "x,d"))
    assert set(audit(ctx)) == {
        ("read", "n_20240101.csv", 6, "", "success"), ("write", "n_20240101.csv", 3, "", "success"),
        ("reject", "n_20240101.csv", 3, f"{tmp_path}/rejects", "success")}


def test_landing_files_and_types_of_the_target(spark, tmp_path):
    ctx = context(spark, tmp_path)
    put(tmp_path / "in" / "n.txt", "k\tv\n1\ta\n2\n")
    result = run(ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{tmp_path}/in/n.txt", target_s3_file_path=f"{tmp_path}/out/n.csv",
                 on_bad_lines="reject", rejects_path=f"{tmp_path}/rejects")
    assert result.ok and result.records == 1
    assert [tuple(r) for r in files.scan_delimited(spark, f"{tmp_path}/out/n.csv").collect()] == [(1, "a")]
    spark.sql("DROP TABLE IF EXISTS typed_rejects")
    spark.sql("CREATE TABLE typed_rejects (v STRING, k INT) USING parquet")
    put(tmp_path / "n.csv", LINES)
    result = run(ctx, spec.FILE_TO_TABLE, 1, source_s3_file_path=f"{tmp_path}/n.csv", target_access_db="warehouse",
                 target_table="typed_rejects", on_bad_lines="reject", rejects_path=f"{tmp_path}/rejects")
    assert result.ok and spark.table("typed_rejects").count() == 3


def test_without_the_choice_a_bad_line_fails_the_load(spark, tmp_path):
    ctx = context(spark, tmp_path)
    put(tmp_path / "n.csv", LINES)
    common = {"source_s3_file_path": f"{tmp_path}/n.csv", "schema": "k int, v string", "target_access_db": "warehouse", "target_table": "no_rejects"}
    assert not run(ctx, spec.FILE_TO_TABLE, **common).ok
    assert "rejects_path" in run(ctx, spec.FILE_TO_TABLE, **common, on_bad_lines="reject").error
    assert "on_bad_lines" in run(ctx, spec.FILE_TO_TABLE, **common, on_bad_lines="skip").error


@pytest.mark.parametrize("name", ["a.csv", "a.parquet"])
def test_counts_without_a_metric(spark, tmp_path, monkeypatch, name):
    """Where no observed number arrives, loads and files are still logged with what they hold."""
    monkeypatch.setattr(counting.RowCount, "reported", lambda self: None)
    ctx = context(spark, tmp_path)
    spark.sql("DROP TABLE IF EXISTS counted")
    put(tmp_path / "n.csv", "k,v\n1,a\n2,b\n")
    load = {"source_s3_file_path": f"{tmp_path}/n.csv", "schema": "k int, v string", "target_access_db": "warehouse", "target_table": "counted"}
    for order, extra in enumerate(({}, {}, {"load_type": "Overwrite"}, {"load_type": "Overwrite", "truncate": "true"})):
        assert run(ctx, spec.FILE_TO_TABLE, order, **load, **extra).records == 2
    assert spark.table("counted").count() == 2
    written = run(ctx, spec.TABLE_TO_FILE, 4, source_access_db="warehouse", source_table="counted", target_s3_file_path=f"{tmp_path}/{name}")
    assert written.ok and written.records == 2
    assert {row[2] for row in audit(ctx)} == {2}


def test_a_metric_that_never_arrives_is_no_error(spark, monkeypatch):
    monkeypatch.setattr(counting, "_WAIT_SECONDS", 0.05)
    assert counting.RowCount(spark.range(3)).reported() is None


def test_insert_count_is_that_of_the_commit(spark):
    spark.sql("DROP TABLE IF EXISTS commits")
    spark.range(5).write.saveAsTable("commits")
    assert counting.committed_rows(spark.sql("INSERT INTO commits SELECT id FROM range(7)")) == 7
    with pytest.raises(PySparkException):
        spark.sql("INSERT INTO commits SELECT raise_error('no')")
