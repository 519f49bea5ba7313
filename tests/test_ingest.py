import pytest
from helpers import put, same_rows

from portage.plans import checks
from portage.sources.tables import TableAccess
from portage.streaming import ingest


def test_each_file_comes_in_once(spark, tmp_path):
    target = f"{checks.new_database(spark)}.t"
    expected = []
    for day in (1, 2, 3):
        put(tmp_path / f"in/x_2024010{day}.csv", f"a,b\n{day},v\n")
        put(tmp_path / f"in/other_2024010{day}.csv", "a,b\n9,v\n")
        expected.append((day, "v"))
        for _ in range(2):
            stream = ingest.read_new_files(spark, f"{tmp_path}/in/x_*.csv", "a int, b string", max_files_per_trigger=1)
            ingest.ingest_available(stream, target, f"{tmp_path}/checkpoint")
        same_rows(spark.table(target), spark.createDataFrame(expected, "a int, b string"))


def test_into_a_folder(spark, tmp_path):
    put(tmp_path / "in/x.txt", "1\tv\n")
    for _ in range(2):
        stream = ingest.read_new_files(spark, f"{tmp_path}/in/*.txt", "a int, b string", header=False, delimiter="\t")
        ingest.ingest_available_to_path(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    same_rows(spark.read.parquet(f"{tmp_path}/out"), spark.createDataFrame([(1, "v")], "a int, b string"))


def test_batch_that_runs_again_adds_nothing(spark, tmp_path):
    """The table has the batch, but the checkpoint has lost its commit."""
    target = f"{checks.new_database(spark)}.t"

    def run():
        stream = ingest.read_new_files(spark, f"{tmp_path}/in/*.csv", "a int")
        ingest.ingest_available_to_database(stream, TableAccess(), target, f"{tmp_path}/checkpoint")

    put(tmp_path / "in/x.csv", "a\n1\n2\n")
    run()
    put(tmp_path / "in/y.csv", "a\n3\n")
    run()
    commits = tmp_path / "checkpoint/commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()
    run()
    same_rows(spark.table(target), spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "a int, batch_id bigint"))


def test_half_loaded_batch_fails(spark, tmp_path):
    target = f"{checks.new_database(spark)}.t"
    spark.createDataFrame([(1, 0)], "a int, batch_id bigint").write.saveAsTable(target)
    put(tmp_path / "in/x.csv", "a\n1\n2\n")
    stream = ingest.read_new_files(spark, f"{tmp_path}/in/*.csv", "a int")
    with pytest.raises(Exception, match="not all of it"):
        ingest.ingest_available_to_database(stream, TableAccess(), target, f"{tmp_path}/checkpoint")
    assert spark.table(target).count() == 1
