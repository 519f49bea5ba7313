import hashlib
import json
import os
import random
import subprocess
import sys

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from portage.operators import arrow_tasks, copying
from portage.plans import checks


def digests(root):
    found = {}
    for directory, _, names in os.walk(root):
        for name in names:
            path = os.path.join(directory, name)
            found[os.path.relpath(path, root)] = hashlib.sha256(open(path, "rb").read()).hexdigest()
    return found


@pytest.fixture
def tree(tmp_path):
    for name, size in {"a.bin": 10, "b/c.csv": 0, "b/d/e.txt": 5000, "_hidden": 3, ".dot/x": 7, "odd name[1].csv": 9}.items():
        path = tmp_path / "from" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(os.urandom(size))
    (tmp_path / "from" / "empty" / "folder").mkdir(parents=True)
    return tmp_path / "from"


def test_listing_has_every_file_and_no_directory(spark, tree):
    rows = copying.list_tree(spark, str(tree)).collect()
    assert {(r.relative, r.length) for r in rows} == {
        ("a.bin", 10), ("b/c.csv", 0), ("b/d/e.txt", 5000), ("_hidden", 3), (".dot/x", 7), ("odd name[1].csv", 9)}
    assert all(r.path == f"file:{tree}/{r.relative}" for r in rows)


def test_tree_copy_is_byte_for_byte(spark, tree, tmp_path):
    copied = copying.copy_tree(spark, str(tree), f"{tmp_path}/to/")
    assert (copied.objects, copied.bytes) == (6, 5029)
    assert digests(tree) == digests(tmp_path / "to")


def test_copying_again_gives_the_same_tree(spark, tree, tmp_path):
    for _ in range(2):
        copying.copy_tree(spark, str(tree), f"{tmp_path}/to")
    assert digests(tree) == digests(tmp_path / "to")


def test_empty_tree(spark, tmp_path):
    (tmp_path / "from").mkdir()
    assert copying.copy_tree(spark, f"{tmp_path}/from", f"{tmp_path}/to").objects == 0


def test_single_file(spark, tree, tmp_path):
    assert copying.copy_file(spark, f"{tree}/odd name[1].csv", f"{tmp_path}/x/y.csv").objects == 1
    assert (tmp_path / "x" / "y.csv").read_bytes() == (tree / "odd name[1].csv").read_bytes()
    assert os.listdir(tmp_path / "x") == ["y.csv"]


def test_file_that_changed_size_fails_and_leaves_no_scratch(spark, tree, tmp_path):
    plan = copying.copy_plan(copying.list_tree(spark, str(tree)), f"file:{tmp_path}/to")
    (tree / "a.bin").write_bytes(b"longer than it was")
    with pytest.raises(Exception, match="instead of"):
        copying.copy_objects(plan, str(tmp_path / "to"))
    assert not [name for name in os.listdir(tmp_path / "to") if name.startswith("_copying")]


@pytest.mark.parametrize("objects, size, cores, tasks", [
    (0, 0, 8, 1), (1, 10**12, 8, 1), (20, 10**6, 8, 1), (400, 10**6, 8, 8), (400, 10**6, 1000, 8),
    (10**6, 10**6, 8, 1000), (10**6, 10**14, 4000, 372530), (4000, 10**14, 400, 4000),
])
def test_copy_tasks(objects, size, cores, tasks):
    assert copying.copy_tasks(objects, size, cores) == tasks


@pytest.mark.parametrize("files_per_range", [7, 40, 1000])
@pytest.mark.parametrize("share", [1, 500, 3000, 10**9])
def test_tasks_are_balanced_by_bytes(spark, share, files_per_range, monkeypatch):
    monkeypatch.setattr(copying, "_OBJECT_BYTES", 10)
    draw = random.Random(share + files_per_range)
    lengths = [draw.choice([0, 1, 400, 499, 500, 2999, 9000, draw.randrange(3000)]) for _ in range(150)]
    rows = [(f"from/{i}", f"to/{i}", length) for i, length in enumerate(lengths)]
    numbered, tasks = copying.balanced_tasks(spark.createDataFrame(rows, "source string, target string, length long"), share, files_per_range)
    found = numbered.collect()
    assert sorted(row[:3] for row in found) == sorted(rows) and {row.task for row in found} == set(range(tasks))
    loads = {}
    for row in found:
        loads.setdefault(row.task, []).append(row.length + 10)
    for load in loads.values():
        assert len(load) == 1 or (max(load) < share and sum(load) < 2 * share)


def test_each_task_number_is_one_task(spark, tree, tmp_path, monkeypatch):
    """Files of very different sizes, copied with a share that makes several tasks."""
    monkeypatch.setattr(copying, "task_bytes", lambda objects, size, cores: 8)
    monkeypatch.setattr(copying, "_OBJECT_BYTES", 1)
    assert copying.copy_tree(spark, str(tree), f"{tmp_path}/to").objects == 6
    assert digests(tree) == digests(tmp_path / "to")


def test_one_wide_directory_is_listed_by_several_tasks(spark, tmp_path):
    wide = tmp_path / "wide" / "in"
    wide.mkdir(parents=True)
    for i in range(50_000):
        (wide / f"{i}.bin").touch()
    rows = copying.list_tree(spark, str(tmp_path / "wide"), parallelism=4)
    assert rows.count() == 50_000 and rows.select("relative").distinct().count() == 50_000
    shares = [row["count"] for row in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(shares) >= 3 and max(shares) < 30_000


def test_streamed_copy(tree, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_tasks, "STREAM_BUFFER", 64)
    local = arrow_tasks.open_filesystem(f"file:{tree}", {})[0]
    arrow_tasks.transfer_bytes(local, f"{tree}/b/d/e.txt", local, f"{tmp_path}/e.txt", streamed=True)
    assert (tmp_path / "e.txt").read_bytes() == (tree / "b/d/e.txt").read_bytes()


def test_paths_of_other_schemes():
    filesystem, path = arrow_tasks.open_filesystem("s3a://bucket/a/b.csv", {"region": "us-east-1", "access_key": "k", "secret_key": "s"})
    assert filesystem.type_name == "s3" and path == "bucket/a/b.csv"


def test_executors_need_not_have_the_package(tree, tmp_path):
    """Copies run where the driver alone can import it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate()
sys.path.insert(0, {root!r})
from portage.operators import copying
assert copying.copy_tree(spark, {str(tree)!r}, {str(tmp_path / 'to')!r}).objects == 6
"""
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert digests(tree) == digests(tmp_path / "to")


_MEMORY = """
import glob, json, sys
from pyspark.sql import SparkSession
repo, work = sys.argv[1:]
sys.path.insert(0, repo)
from portage.plans.checks import CHECKS
settings = {"spark.ui.enabled": "false", "spark.checkpoint.dir": f"file:{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse",
            "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file:{work}", "spark.eventLog.rolling.enabled": "false",
            "spark.eventLog.compress": "false", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
flags = ["CASE id % 4 WHEN 3 THEN NULL ELSE chr(65 + id % 4) END AS l_returnflag", "chr(79 + id % 2) AS l_linestatus"]
spark.range(40000).selectExpr("id AS l_orderkey", *flags).write.parquet(f"{work}/lineitem.parquet")
objects = CHECKS["copy_counts"].query(spark, work).first()["objects"]
copied = CHECKS["copy_tree"].query(spark, work).count()
spark.stop()
memory = []
for line in open(glob.glob(f"{work}/local-*")[0]):
    event = json.loads(line)
    if event["Event"] == "SparkListenerTaskEnd":
        metrics = event["Task Metrics"]
        if metrics["Output Metrics"]["Records Written"] >= 5000 and metrics["Shuffle Read Metrics"]["Total Records Read"]:
            memory.append(metrics["Peak Execution Memory"])
print(json.dumps([objects, copied, len(memory), max(memory)]))
"""


def test_rows_of_a_folder_are_not_sorted_first(tmp_path):
    """The tasks that write the trees of both queries hold no rows, so their memory does not grow with the rows."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "events").mkdir()
    command = [sys.executable, "-c", _MEMORY, repo, str(tmp_path / "events")]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    objects, copied, writers, memory = json.loads(done.stdout.splitlines()[-1])
    assert objects == 4 and copied == 40000 and writers >= 9
    assert memory == 0


def test_folders_have_one_file_a_key_of_a_task(spark, tmp_path):
    """Also for more keys than files that are open at once, and for a null; the setting is put back."""
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 100 > 0 THEN id % 100 END AS k").coalesce(1)
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    checks.write_folders(rows, f"{tmp_path}/out", "k")
    assert spark.conf.get(setting) == before
    folders = [d for d in (tmp_path / "out").iterdir() if d.is_dir()]
    assert len(folders) == 100 and all(len(list(d.glob("part-*"))) == 1 for d in folders)
    same_rows(spark.read.parquet(f"{tmp_path}/out").select("id", F.col("k").cast("long")), rows)
