import os

import pytest
from helpers import put, same_rows
from pyspark.sql import functions as F

from portage.operators import file_sinks
from portage.sources import files, manifest

TRICKY = [(1, "plain"), (2, 'quote " and, comma'), (3, " outer blanks "), (4, "ünïcode"), (5, "tab\there"), (6, None)]


@pytest.fixture
def tricky(spark):
    return spark.createDataFrame(TRICKY, "k int, v string")


@pytest.mark.parametrize("layout", ["file", "parts"])
@pytest.mark.parametrize("name, delimiter", [("t.csv", ","), ("t.txt", "\t"), ("t.csv", "|")])
def test_delimited_round_trip(spark, tmp_path, tricky, name, delimiter, layout):
    published = file_sinks.write_delimited(
        tricky.repartition(4), f"{tmp_path}/{name}", delimiter=delimiter, layout=layout
    )
    assert published.rows == 6 and published.name == name
    assert os.path.isfile(tmp_path / name) == (layout == "file")
    same_rows(files.scan_delimited(spark, published.path, delimiter=delimiter, schema=tricky.schema), tricky)


def test_single_file_has_one_header_and_all_rows(spark, tmp_path):
    file_sinks.write_delimited(spark.range(100).repartition(7), f"{tmp_path}/n.csv", layout="file")
    lines = (tmp_path / "n.csv").read_text().splitlines()
    assert lines[0] == "id" and sorted(map(int, lines[1:])) == list(range(100))


@pytest.mark.parametrize("layout", ["file", "parts"])
def test_parquet_publishes_every_part(spark, tmp_path, layout):
    df = spark.range(10000).repartition(4)
    published = file_sinks.write_parquet(df, f"{tmp_path}/n.parquet", layout)
    assert published.rows == 10000
    same_rows(spark.read.parquet(published.path), df)
    assert os.path.isfile(tmp_path / "n.parquet") == (layout == "file")


def test_parquet_parts_in_a_folder_with_glob_characters(spark, tmp_path):
    file_sinks.write_parquet(spark.range(10).repartition(3), f"{tmp_path}/a[1]*/n.parquet", "file")
    assert os.path.isfile(tmp_path / "a[1]*" / "n.parquet")


def test_publishing_replaces_and_leaves_nothing_behind(spark, tmp_path):
    for rows, layout in ((50, "parts"), (20, "file"), (30, "parts"), (10, "file")):
        file_sinks.write_delimited(spark.range(rows).repartition(3), f"{tmp_path}/n.csv", layout=layout)
        assert files.scan_delimited(spark, f"{tmp_path}/n.csv").count() == rows
        assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["n.csv"]


def test_failed_write_keeps_the_old_file(spark, tmp_path):
    file_sinks.write_delimited(spark.range(5), f"{tmp_path}/n.csv")
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        file_sinks.write_delimited(broken, f"{tmp_path}/n.csv")
    assert files.scan_delimited(spark, f"{tmp_path}/n.csv").count() == 5
    assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["n.csv"]


def test_parts_written_in_place_where_a_rename_would_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_sinks.storage, "RENAME_COPIES", frozenset({"file"}))
    for layout in ("parts", "file"):
        file_sinks.write_delimited(spark.range(40).repartition(4), f"{tmp_path}/n.csv", layout=layout)
        assert files.scan_delimited(spark, f"{tmp_path}/n.csv").count() == 40
    assert os.path.isfile(tmp_path / "n.csv")


def test_failed_write_in_place_keeps_the_old_parts(spark, tmp_path, monkeypatch):
    """Where a rename would copy, too: what a failed write leaves is not read, and the next one replaces the old parts."""
    monkeypatch.setattr(file_sinks.storage, "RENAME_COPIES", frozenset({"file"}))
    broken = spark.range(0, 500, 1, 4).select(F.when(F.col("id") == 499, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for write, read in ((file_sinks.write_delimited, files.scan_delimited), (file_sinks.write_parquet, files.scan_parquet)):
        path = f"{tmp_path}/n.{'csv' if write is file_sinks.write_delimited else 'parquet'}"
        assert write(spark.range(40).repartition(4), path).rows == 40
        with pytest.raises(Exception):
            write(broken, path)
        assert read(spark, path).count() == 40
        assert write(spark.range(7).repartition(2), path).rows == 7
        assert sorted(r[0] for r in read(spark, path).collect()) == list(range(7))


def test_no_rows(spark, tmp_path):
    published = file_sinks.write_delimited(spark.range(10).where("id < 0"), f"{tmp_path}/none.csv", layout="file")
    assert published.rows == 0
    assert (tmp_path / "none.csv").read_text() == "id\n"


def test_microseconds_survive(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.179575' AS a, timestamp'2024-01-01 00:00:07.179575' AS b")
    published = file_sinks.write_delimited(df, f"{tmp_path}/t.csv")
    same_rows(files.scan_delimited(spark, published.path, schema=df.schema), df)


def test_raw_scan_keeps_the_first_line_as_a_row(spark, tmp_path):
    put(tmp_path / "r.txt", "a\tb\n1\tx,y\n")
    raw = files.scan_raw(spark, f"{tmp_path}/r.txt")
    assert [tuple(r) for r in raw.collect()] == [("a", "b"), ("1", "x,y")]
    file_sinks.write_raw(raw, f"{tmp_path}/r.csv", layout="file")
    assert (tmp_path / "r.csv").read_text() == 'a,b\n1,"x,y"\n'


def test_directory_deep_below_the_root(spark, tmp_path):
    """Direct children at any depth; siblings that share a prefix and nested directories are left out."""
    base = tmp_path / "a" / "b" / "c"
    put(base / "x.csv", "k,v\n1,p\n")
    put(base / "y.txt", "k,v\n2,q\n")
    put(base / "notes.md", "k,v\n9,z\n")
    put(base / "deeper" / "z.csv", "k,v\n3,r\n")
    put(tmp_path / "a" / "b" / "c2" / "w.csv", "k,v\n4,s\n")
    spark.createDataFrame([(5, "t")], "k int, v string").coalesce(1).write.parquet(f"{base}/w.parquet")
    scan = files.scan_file(spark, f"{base}/")
    assert sorted(tuple(r) for r in scan.df.collect()) == [(1, "p"), (2, "q"), (5, "t")]
    names = sorted(row.source_file for row in scan.names.collect())
    assert scan.name == "MultipleFiles" and names == ["w.parquet", "x.csv", "y.txt"]


def test_every_file_of_a_large_directory_is_named(spark, tmp_path):
    for i in range(1100):
        put(tmp_path / f"{i}.csv", "k\n1\n")
    names = {row.source_file for row in files.scan_file(spark, str(tmp_path)).names.collect()}
    assert names == {f"{i}.csv" for i in range(1100)}


def test_source_file_lineage(spark, tmp_path):
    put(tmp_path / "x.csv", "k\n1\n")
    put(tmp_path / "y.csv", "k\n2\n")
    rows = files.with_source_file(files.scan_directory(spark, str(tmp_path))).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "x.csv"), (2, "y.csv")]


def test_published_folder_counts_as_one_file(spark, tmp_path):
    file_sinks.write_delimited(spark.range(40).repartition(4), f"{tmp_path}/n_20240101.csv")
    row = manifest.list_files(spark, str(tmp_path)).first()
    assert (row.name, row.parts) == ("n_20240101.csv", 4)
    assert files.scan_file(spark, f"{tmp_path}/n_yyyymmdd.csv").df.count() == 40


def test_missing_sources(spark, tmp_path):
    for path in ("x.csv", "x_yyyymmdd.csv", "."):
        with pytest.raises(FileNotFoundError):
            files.scan_file(spark, f"{tmp_path}/{path}")
    assert manifest.list_files(spark, str(tmp_path)).isEmpty()


def test_directory_with_columns_in_other_orders(spark, tmp_path):
    put(tmp_path / "x.csv", "a,b\n1,2\n")
    put(tmp_path / "y.csv", "b,a\r\n4,3\r\n")
    put(tmp_path / "z.txt", "\n\"b\",a\n6,5\n")
    put(tmp_path / "empty.csv", "")
    file_sinks.write_delimited(spark.createDataFrame([(8, 7)], "b int, a int"), f"{tmp_path}/parts.csv")
    spark.createDataFrame([(9, 10)], "a int, b int").write.parquet(f"{tmp_path}/p.parquet")
    expected = [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    for options in ({}, {"schema": "a int, b int"}):
        scan = files.scan_directory(spark, str(tmp_path), **options)
        assert sorted(tuple(r) for r in scan.select("a", "b").collect()) == expected
    assert scan.columns == ["a", "b"]
    index = {os.path.basename(r.path): r.header for r in files.header_index(spark, str(tmp_path)).collect()}
    assert index == {"x.csv": "a,b", "y.csv": "b,a", "z.txt": '"b",a', "parts.csv": "b,a"}


def test_directory_with_other_columns_is_refused(spark, tmp_path):
    put(tmp_path / "x.csv", "a,b\n1,2\n")
    put(tmp_path / "y.csv", "b,c\n2,1\n")
    for options in ({}, {"schema": "a int, b int"}):
        with pytest.raises(Exception, match="header|column"):
            files.scan_directory(spark, str(tmp_path), **options).collect()


def test_too_many_header_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_HEADERS", 2)
    for i, header in enumerate(("a,b,c", "b,a,c", "c,b,a")):
        put(tmp_path / f"{i}.csv", f"{header}\n1,2,3\n")
    with pytest.raises(ValueError, match="more than 2"):
        files.scan_directory(spark, str(tmp_path))


def test_lineage_of_odd_names_and_parts(spark, tmp_path):
    put(tmp_path / "a b+%20.csv", "id\n1\n")
    file_sinks.write_delimited(spark.range(4).repartition(2), f"{tmp_path}/n.csv")
    rows = files.with_source_file(files.scan_directory(spark, str(tmp_path))).select("source_file").distinct().collect()
    assert {r[0] for r in rows} == {"a b+%20.csv", "n.csv"}


def test_null_and_empty_string_with_options(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "k int, v string")
    marks = {"nullValue": "\\N"}
    published = file_sinks.write_delimited(df, f"{tmp_path}/n.csv", **marks)
    same_rows(files.scan_delimited(spark, published.path, schema=df.schema, **marks), df)


@pytest.mark.parametrize("rows", [1, 1_000_000])
def test_kind_of_output_does_not_depend_on_size(spark, tmp_path, rows):
    df = spark.range(rows).coalesce(1)
    file_sinks.write_delimited(df, f"{tmp_path}/n.csv")
    file_sinks.write_parquet(df, f"{tmp_path}/n.parquet")
    file_sinks.write_delimited(df.repartition(3), f"{tmp_path}/one.csv", layout="file", compression="gzip")
    assert os.path.isdir(tmp_path / "n.csv") and os.path.isdir(tmp_path / "n.parquet")
    assert os.path.isfile(tmp_path / "one.csv")


def test_unknown_layout(spark, tmp_path):
    with pytest.raises(ValueError, match="layout"):
        file_sinks.write_delimited(spark.range(1), f"{tmp_path}/n.csv", layout="pars")
