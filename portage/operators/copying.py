"""Byte-for-byte copies of files, spread over the executors.

Listings and copies use Arrow file systems inside the tasks, so no object passes through the driver or through rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portage import storage
from portage.operators import arrow_tasks
from portage.session import shared_dir, stored

cloudpickle.register_pickle_by_value(arrow_tasks)

_LISTING = "path string, relative string, length bigint, is_directory boolean"
_COPIED = "target string, length bigint"
# A task's work at most, however many cores there are, and at least, so that a few small files do not start many tasks.
_MOST_BYTES, _LEAST_BYTES = 256 * 1024 * 1024, 16 * 1024 * 1024
_MOST_OBJECTS, _LEAST_OBJECTS = 1000, 50
_LEAST_DIRECTORIES = 16
# What a file counts for beyond its bytes, so that a task has few enough, and files whose sizes are summed together.
_OBJECT_BYTES = _MOST_BYTES // (2 * _MOST_OBJECTS)
_FILES_PER_RANGE = 100_000


@dataclass(frozen=True)
class Copied:
    objects: int
    bytes: int


def list_tree(spark: SparkSession, root: str, options: dict | None = None, parallelism: int | None = None) -> DataFrame:
    """Every file below a directory: path, path relative to the root, length. Hidden files count, directories do not.

    One job lists all directories of one depth; each level is kept as a table, so a lost executor repeats little. Where a
    level has fewer directories than there are tasks, each is split by its names over several.
    """
    options = options or {}
    tasks = parallelism or spark.sparkContext.defaultParallelism
    base = shared_dir(spark, "listing")

    list_children = arrow_tasks.list_children
    levels: list[str] = []
    start = (storage.qualify(spark, root), "")
    frontier = spark.createDataFrame([start], "path string, relative string")
    directories = 1
    while directories:
        levels.append(f"{base}/level-{len(levels)}")
        parts = max(1, tasks // directories)
        split = frontier.select("path", "relative", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(parts).alias("parts"))
        split = split.repartition(tasks if parts > 1 else min(tasks, math.ceil(directories / _LEAST_DIRECTORIES)), "path", "part")
        split.mapInArrow(lambda batches: list_children(batches, options), _LISTING).write.parquet(levels[-1])
        level = spark.read.schema(_LISTING).parquet(levels[-1])
        frontier = level.where("is_directory").select("path", F.concat("relative", F.lit("/")).alias("relative"))
        directories = frontier.count()
    return spark.read.schema(_LISTING).parquet(*levels).where("not is_directory").drop("is_directory")


def copy_plan(listing: DataFrame, target: str) -> DataFrame:
    """Where each listed file goes: the target prefix followed by its relative path."""
    place = F.concat(F.lit(target.rstrip("/") + "/"), F.col("relative"))
    return listing.select(F.col("path").alias("source"), place.alias("target"), "length")


def copy_tasks(objects: int, size: int, cores: int) -> int:
    """Number of copy tasks: as many as keep the cores busy, unless the work per task gets too small or too large."""
    useful = max(math.ceil(size / _LEAST_BYTES), math.ceil(objects / _LEAST_OBJECTS), 1)
    needed = max(math.ceil(size / _MOST_BYTES), math.ceil(objects / _MOST_OBJECTS))
    return max(min(objects, max(needed, min(cores, useful))), 1)


def task_bytes(objects: int, size: int, cores: int) -> int:
    """Weight at which the files of a task are cut off: an even share of the tasks, half of the most at most."""
    weight = size + objects * _OBJECT_BYTES
    return max(min(weight // copy_tasks(objects, size, cores), _MOST_BYTES // 2), 1)


def balanced_tasks(plan: DataFrame, bytes_per_task: int, files_per_range: int = _FILES_PER_RANGE) -> tuple[DataFrame, int]:
    """The plan with the number of a task for each file, and the number of tasks.

    Files go by falling length, and a task takes those whose running total, before them, lies in one stretch of
    ``bytes_per_task``. So a file of that size or more is alone, and no other task has twice as much. Each file counts for
    a little more than its bytes, which bounds the number of files as well. Totals are summed in ranges of files first;
    the driver sees one row per range.
    """
    spark = plan.sparkSession
    weight = (F.col("length") + F.lit(_OBJECT_BYTES)).alias("weight")
    ranges = max(1, -(-plan.count() // files_per_range))
    ordered = plan.select("*", weight).repartitionByRange(ranges, F.desc("weight"), "source").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(F.desc("weight"), "source")
    running = F.sum("weight").over(within.rowsBetween(Window.unboundedPreceding, -1))
    placed = stored(ordered.withColumn("before", F.coalesce(running, F.lit(0).cast("long"))), "placed")
    heads, base = [], 0
    for row in placed.groupBy("part").agg(F.sum("weight").alias("weight")).orderBy("part").collect():
        heads.append((row["part"], base))
        base += row["weight"]
    offsets = F.broadcast(spark.createDataFrame(heads, "part int, head long"))
    stretch = F.floor((F.col("head") + F.col("before")) / F.lit(bytes_per_task))
    cut = placed.join(offsets, "part").withColumn("stretch", stretch)
    numbered, tasks, last = [], 0, None
    for row in cut.groupBy("part").agg(
        F.min("stretch").alias("lo"), F.max("stretch").alias("hi"), F.count_distinct("stretch").alias("n")
    ).orderBy("part").collect():
        first = tasks - (row["lo"] == last)  # the stretch in which the range before ended goes on
        numbered.append((row["part"], first))
        tasks, last = first + row["n"], row["hi"]
    firsts = F.broadcast(spark.createDataFrame(numbered, "part int, first int"))
    rank = F.dense_rank().over(Window.partitionBy("part").orderBy("stretch"))
    return cut.join(firsts, "part").select(*plan.columns, (F.col("first") + rank - 1).alias("task")), tasks


def copy_objects(
    plan: DataFrame, target_root: str, source_options: dict | None = None, target_options: dict | None = None
) -> Copied:
    """Run a copy plan and count its objects and bytes.

    Tasks get about equally many bytes, few enough to be short. A task that runs again writes the same bytes again, and a
    file shows under its name only when it is whole. What a lost executor leaves unfinished lies in a scratch folder
    below the target, which goes at the end.
    """
    spark = plan.sparkSession
    source_options, target_options = source_options or {}, target_options or {}
    scratch = storage.join(storage.qualify(spark, target_root), f"_copying_{uuid.uuid4().hex}")
    copy_files = arrow_tasks.copy_files
    totals = plan.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if not totals["objects"]:
        return Copied(0, 0)
    share = task_bytes(totals["objects"], totals["bytes"], spark.sparkContext.defaultParallelism)
    numbered, tasks = balanced_tasks(plan, share)
    spread = numbered.repartitionById(tasks, F.col("task")).drop("task")
    copied = spread.mapInArrow(lambda batches: copy_files(batches, scratch, source_options, target_options), _COPIED)
    try:
        return Copied(*copied.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first())
    finally:
        storage.delete(spark, scratch)


def copy_tree(
    spark: SparkSession,
    source: str,
    target: str,
    source_options: dict | None = None,
    target_options: dict | None = None,
) -> Copied:
    """Copy every file below a directory, keeping relative paths."""
    if not storage.is_directory(spark, source):
        raise FileNotFoundError(f"no directory {source}")
    plan = copy_plan(list_tree(spark, source, source_options), storage.qualify(spark, target))
    return copy_objects(plan, target, source_options, target_options)


def copy_file(
    spark: SparkSession,
    source: str,
    target: str,
    source_options: dict | None = None,
    target_options: dict | None = None,
) -> Copied:
    """Copy one file, or all parts of a folder that stands for one file, to an exact path."""
    if storage.is_directory(spark, source):
        return copy_tree(spark, source, target, source_options, target_options)
    plan = (
        spark.read.format("binaryFile")
        .load(storage.glob_escape(source))
        .select(
            F.lit(storage.qualify(spark, source)).alias("source"),
            F.lit(storage.qualify(spark, target)).alias("target"),
            "length",
        )
    )
    return copy_objects(plan, storage.parent(target), source_options, target_options)
