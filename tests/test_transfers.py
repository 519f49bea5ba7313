"""The transfers end to end: rows, log and names, also where a source is missing, empty or odd."""

import os

import pytest
from helpers import audit, context, put, run, same_rows

from portage.operators import file_sinks
from portage.operators.registry import Registry, recipient_rows
from portage.plans import checks, spec
from portage.plans.runs import run_tasks
from portage.plans.spec import PipelineSpec, TaskSpec, load_pipeline
from portage.sources.tables import TableAccess

STAMPED = "20240201123030"


def sample_text(rows, delimiter="\t"):
    lines = [delimiter.join(("flair", "hour", "score"))]
    lines += [delimiter.join(("Blog" if i % 10 == 0 else "News", str(i % 24), str(i))) for i in range(rows)]
    return "\n".join(lines) + "\n"


@pytest.fixture
def ctx(spark, tmp_path):
    return context(spark, tmp_path)


@pytest.fixture
def target(spark):
    return f"{checks.new_database(spark)}.t"


def test_exact_source_and_target_names_are_copied(ctx, tmp_path):
    put(tmp_path / "a.csv", "x\n")
    result = run(ctx, spec.FILE_TO_FILE, source_s3_file_path=f"{tmp_path}/a.csv", target_s3_file_path=f"{tmp_path}/out/b.csv")
    assert result.ok and (tmp_path / "out/b.csv").read_text() == "x\n"
    assert audit(ctx) == [("copy", "", 1, "b.csv", "success")]


def test_folders_with_glob_characters(spark, ctx, tmp_path, target):
    odd = tmp_path / "a[1]{x,y}*"
    put(odd / "in/s_20240101.txt", sample_text(4))
    landed = run(ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{odd}/in/s_yyyymmdd.txt", target_s3_file_path=f"{odd}/out/s.parquet")
    loaded = run(ctx, spec.FILE_TO_TABLE, source_s3_file_path=f"{odd}/out/", target_access_db="warehouse", target_table=target)
    copied = run(ctx, spec.FILE_TO_FILE, source_s3_file_path=f"{odd}/in", target_s3_file_path=f"{odd}/copy")
    assert (landed.records, loaded.records, copied.records) == (4, 4, 1)
    assert os.listdir(odd / "copy") == ["s_20240101.txt"]


def test_copy_into_a_directory_keeps_the_source_name(ctx, tmp_path):
    put(tmp_path / "a_20240101.csv", "x\n")
    run(ctx, spec.FILE_TO_FILE, source_s3_file_path=f"{tmp_path}/a_yyyymmdd.csv", target_s3_file_path=f"{tmp_path}/out/")
    assert os.listdir(tmp_path / "out") == ["a_20240101.csv"]


def test_copied_directory_counts_files_not_folders(ctx, tmp_path):
    put(tmp_path / "from/a.csv", "x\n")
    put(tmp_path / "from/b/c.csv", "y\n")
    (tmp_path / "from/empty").mkdir()
    run(ctx, spec.FILE_TO_FILE, source_s3_file_path=f"{tmp_path}/from", target_s3_file_path=f"{tmp_path}/to")
    assert audit(ctx) == [("copy", "", 2, "Multiple files", "success")]


@pytest.mark.parametrize("source", ["none", "none.csv", "none_yyyymmdd.csv", "empty"])
def test_copy_without_a_source_is_logged_as_failed(ctx, tmp_path, source):
    (tmp_path / "empty").mkdir()
    result = run(ctx, spec.FILE_TO_FILE, source_s3_file_path=f"{tmp_path}/{source}", target_s3_file_path=f"{tmp_path}/to")
    assert not result.ok and result.error
    assert audit(ctx) == [("copy", "", 0, "", "failed")]


def test_landing_counts_data_rows_on_both_sides(ctx, tmp_path):
    """Tab to comma, for a newest and for an exact source name; the header line is kept and not counted."""
    put(tmp_path / "in/sftp_20241011.txt", sample_text(918))
    for name in ("sftp_yyyymmdd.txt", "sftp_20241011.txt"):
        result = run(
            ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{tmp_path}/in/{name}",
            target_s3_file_path=f"{tmp_path}/out/s_yyyymmdd.csv", layout="file",
        )
        assert result.records == 918 and result.target.endswith("/out/s_20240201.csv")
    assert (tmp_path / "out/s_20240201.csv").read_text() == sample_text(918, ",")
    assert {a[:3] for a in audit(ctx)} == {("read", "sftp_20241011.txt", 918), ("write", "sftp_20241011.txt", 918)}


def test_landing_without_header_line(ctx, tmp_path):
    put(tmp_path / "in/x.csv", "1,a\n2,b\n")
    result = run(
        ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{tmp_path}/in/x.csv", target_s3_file_path=f"{tmp_path}/out/",
        header_row="False", layout="file",
    )
    assert result.records == 2 and (tmp_path / "out/x.csv").read_text() == "1,a\n2,b\n"


def test_landing_path_names_a_file(ctx, tmp_path):
    put(tmp_path / "in/x.csv", "a\n1\n")
    assert not run(ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{tmp_path}/in/", target_s3_file_path=f"{tmp_path}/out/").ok
    assert audit(ctx) == [("read", "", 0, "", "failed")]


def test_landing_takes_parquet(spark, ctx, tmp_path):
    file_sinks.write_parquet(spark.range(7), f"{tmp_path}/in/x_20240101.parquet")
    result = run(
        ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{tmp_path}/in/x_yyyymmdd.parquet",
        target_s3_file_path=f"{tmp_path}/out/",
    )
    assert result.records == 7 and spark.read.parquet(result.target).count() == 7


def test_landing_of_many_parts_keeps_every_row(spark, ctx, tmp_path):
    """A header in each part stays a header in each part."""
    file_sinks.write_delimited(spark.range(100).repartition(5), f"{tmp_path}/in/n.txt", delimiter="\t")
    result = run(ctx, spec.LANDING_TO_FILE, source_sftp_file_path=f"{tmp_path}/in/n.txt", target_s3_file_path=f"{tmp_path}/n.csv")
    assert result.records == 100
    same_rows(spark.read.csv(result.target, header=True, schema="id bigint"), spark.range(100))


def test_load_without_input_is_logged_as_failed(ctx, tmp_path, target):
    result = run(
        ctx, spec.FILE_TO_TABLE, source_s3_file_path=f"{tmp_path}/x_yyyymmdd.csv", target_access_db="warehouse",
        target_table=target,
    )
    assert not result.ok
    assert audit(ctx) == [("read", "", 0, "", "failed")]


def test_load_of_no_rows_succeeds(spark, ctx, tmp_path, target):
    put(tmp_path / "x.csv", "a,b\n")
    result = run(
        ctx, spec.FILE_TO_TABLE, source_s3_file_path=f"{tmp_path}/x.csv", target_access_db="warehouse",
        target_table=target, schema="a int, b string",
    )
    assert result.ok and result.records == 0
    assert {a[-1] for a in audit(ctx)} == {"success"} and spark.table(target).count() == 0


def test_load_infers_types_and_appends(spark, ctx, tmp_path, target):
    put(tmp_path / "x_20240101.csv", "a;b\n1;x\n")
    for _ in range(2):
        run(
            ctx, spec.FILE_TO_TABLE, source_s3_file_path=f"{tmp_path}/x_yyyymmdd.csv", file_delimiter=";",
            target_access_db="warehouse", target_table=target, load_type="Append",
        )
    same_rows(spark.table(target), spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string"))


def test_value_that_does_not_fit_the_target_fails(spark, ctx, tmp_path, target):
    checks.table_sinks.load_table(spark.sql("SELECT 1 AS a, 'x' AS `b.c`"), TableAccess(), target)
    params = {"target_access_db": "warehouse", "target_table": target, "types_from_target": "True"}
    put(tmp_path / "good.csv", "b.c,a\n7,2\n")
    put(tmp_path / "bad.csv", "a,b.c\nnot a number,y\n")
    assert run(ctx, spec.FILE_TO_TABLE, 0, source_s3_file_path=f"{tmp_path}/good.csv", **params).ok
    assert not run(ctx, spec.FILE_TO_TABLE, 1, source_s3_file_path=f"{tmp_path}/bad.csv", **params).ok
    same_rows(spark.table(target), spark.createDataFrame([(1, "x"), (2, "7")], "a int, `b.c` string"))


def test_load_of_a_directory_names_its_files(spark, ctx, tmp_path, target):
    put(tmp_path / "d/x.csv", "a\n1\n")
    put(tmp_path / "d/y.csv", "a\n2\n")
    run(ctx, spec.FILE_TO_TABLE, source_s3_file_path=f"{tmp_path}/d/", target_access_db="warehouse", target_table=target)
    assert audit(ctx) == [("read", "MultipleFiles", 2, "", "success"), ("write", "MultipleFiles", 2, "", "success")]
    names = ctx.log.read_source_files(ctx.run_id).collect()
    assert sorted(tuple(row) for row in names) == [(ctx.run_id, 0, "x.csv"), (ctx.run_id, 0, "y.csv")]


def test_load_with_another_schema_is_logged_as_failed(spark, ctx, tmp_path, target):
    put(tmp_path / "x.csv", "a\n1\n")
    put(tmp_path / "y.csv", "other\n1\n")
    for name in ("x.csv", "y.csv"):
        result = run(
            ctx, spec.FILE_TO_TABLE, source_s3_file_path=f"{tmp_path}/{name}", target_access_db="warehouse", target_table=target
        )
    assert not result.ok and ("write", "y.csv", 0, "", "failed") in audit(ctx)
    assert spark.table(target).count() == 1


def test_unknown_access_is_logged_as_failed(ctx, tmp_path):
    result = run(ctx, spec.TABLE_TO_FILE, source_access_db="nowhere", source_table="a.b", target_s3_file_path=f"{tmp_path}/")
    assert "nowhere" in result.error and audit(ctx)[0][-1] == "failed"


def test_query_with_quotes_is_logged_as_it_is(spark, ctx, tmp_path, target):
    checks.table_sinks.load_table(spark.sql("SELECT 'it''s' AS a"), TableAccess(), target)
    dml = f"SELECT * FROM {target} WHERE a = 'it\\'s'"
    result = run(
        ctx, spec.TABLE_TO_FILE, source_access_db="warehouse", source_table=target, dml=dml,
        target_s3_file_path=f"{tmp_path}/out/",
    )
    assert result.target.endswith(f"/out/t_{STAMPED}.csv") and result.records == 1
    assert audit(ctx)[0][1] == f"( {dml} ) AS query"


@pytest.mark.parametrize("name, delimiter, text", [("o_yyyymmdd.csv", "", "a,b\n1,x\n"), ("o_yyyymmdd.txt", "|", "a|b\n1|x\n")])
def test_table_to_text(spark, ctx, tmp_path, target, name, delimiter, text):
    checks.table_sinks.load_table(spark.sql("SELECT 1 AS a, 'x' AS b"), TableAccess(), target)
    result = run(
        ctx, spec.TABLE_TO_FILE, source_access_db="warehouse", source_table=target, dml="",
        target_s3_file_path=f"{tmp_path}/out/{name}", target_file_delimiter=delimiter, layout="file",
    )
    assert open(result.target.removeprefix("file:")).read() == text
    assert audit(ctx)[1][3] == name.replace("yyyymmdd", "20240201")


def test_table_to_table_of_no_rows_succeeds(spark, ctx, target):
    checks.table_sinks.load_table(spark.range(5), TableAccess(), target)
    result = run(
        ctx, spec.TABLE_TO_TABLE, source_access_db="warehouse", source_table=target, dml=f"SELECT * FROM {target} WHERE id < 0",
        target_access_db="warehouse", target_table=f"{target}2",
    )
    assert result.ok and result.records == 0 and spark.table(f"{target}2").count() == 0


def test_database_that_cannot_be_reached_is_logged_as_failed(spark, tmp_path):
    ctx = context(spark, tmp_path, shop=TableAccess("PSQL", "db.example.org", "me", "secret"))
    result = run(
        ctx, spec.TABLE_TO_FILE, source_access_db="shop", source_table="shop.public.orders",
        target_s3_file_path=f"{tmp_path}/out/",
    )
    assert not result.ok
    assert audit(ctx) == [("read", "( SELECT * FROM shop.public.orders ) AS query", 0, "", "failed")]


def test_arrays_go_to_parquet_but_not_to_text(spark, ctx, tmp_path, sf_dir):
    database = checks._store(spark, sf_dir, "embeddings")
    source = {"source_access_db": "warehouse", "source_table": f"{database}.embeddings"}
    assert not run(ctx, spec.TABLE_TO_FILE, 0, **source, target_s3_file_path=f"{tmp_path}/e.csv").ok
    written = run(ctx, spec.TABLE_TO_FILE, 1, **source, target_s3_file_path=f"{tmp_path}/e.parquet")
    same_rows(spark.read.parquet(written.target), spark.table(f"{database}.embeddings"))
    assert [a[0::4] for a in audit(ctx)] == [
        ("read", "success"), ("write", "failed"), ("read", "success"), ("write", "success")]


def chain(tmp_path, target):
    return [
        TaskSpec(spec.LANDING_TO_FILE, {
            "source_sftp_file_path": f"{tmp_path}/in/s_yyyymmddHHMMSS.txt", "target_s3_file_path": f"{tmp_path}/s3/s_yyyymmdd.csv"}),
        TaskSpec(spec.FILE_TO_TABLE, {
            "source_s3_file_path": f"{tmp_path}/s3/s_yyyymmdd.csv", "target_access_db": "warehouse", "target_table": target}),
        TaskSpec(spec.TABLE_TO_FILE, {
            "source_access_db": "warehouse", "source_table": target, "dml": f"SELECT * FROM {target} WHERE flair = 'Blog'",
            "target_s3_file_path": f"{tmp_path}/db/d_yyyymmddHHMMSS.parquet"}),
    ]


def test_ordered_run(spark, ctx, tmp_path, target):
    put(tmp_path / "in/s_20241011053445.txt", sample_text(5))
    put(tmp_path / "in/s_20241014123030.txt", sample_text(918))
    report = run_tasks(ctx, chain(tmp_path, target)).collect()
    assert [(r.service, r.task_order, r.Records, r.status) for r in report] == [
        ("SFTP-S3", 0, 918, "success"), ("S3-DB", 1, 918, "success"), ("DB-S3", 2, 92, "success")]
    assert report[2].target_file == f"d_{STAMPED}.parquet"
    assert spark.read.parquet(f"{tmp_path}/db/d_{STAMPED}.parquet").count() == 92


@pytest.mark.parametrize("on_failure, statuses", [("continue", ["failed"] * 3), ("stop", ["failed"])])
def test_run_with_failures_still_reports(spark, ctx, tmp_path, target, on_failure, statuses):
    report = run_tasks(ctx, chain(tmp_path, target), on_failure).collect()
    assert [r.status for r in report] == statuses


FORM = {"select_service_1": "S3 to DB", "target_table_1": "a", "select_service_2": "DB to DB", "target_table_2": "b",
        "select_service_10": "S3 to DB", "target_table_10": "c"}


def test_form_keeps_tasks_apart():
    """Task 1 does not take task 10's parameters, and two tasks of one service stay two."""
    pipeline = PipelineSpec.from_form("p", FORM, "x@example.org, y@example.org,", "0 0 * * *")
    assert [(t.service, t.params) for t in pipeline.tasks] == [
        ("S3 to DB", {"target_table": "a"}), ("DB to DB", {"target_table": "b"}), ("S3 to DB", {"target_table": "c"})]
    assert pipeline.recipients == ["x@example.org", "y@example.org"]


def test_registry_round_trip(spark, tmp_path):
    pipelines = Registry(spark, f"{tmp_path}/pipelines")
    first = PipelineSpec.from_form("p", FORM, "x@example.org,y@example.org")
    newer = PipelineSpec("p", first.tasks[:1], ["z@example.org"], "0 0 * * *")
    for pipeline in (first, PipelineSpec("q", first.tasks), newer):
        pipelines.append(pipeline.to_row(spark))
    stored = pipelines.read()
    assert [r.id for r in stored.orderBy("id").collect()] == sorted({r.id for r in stored.collect()})
    assert load_pipeline(stored, "p") == newer
    assert load_pipeline(stored, "q").tasks == first.tasks
    assert recipient_rows(stored.where("id = 1")).count() == 2
    with pytest.raises(LookupError):
        load_pipeline(stored, "none")


def test_unknown_service():
    with pytest.raises(ValueError):
        TaskSpec("FTP to S3", {})
