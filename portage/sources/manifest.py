"""Listings of files as DataFrames, and the choice of the newest stamped name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage import storage
from portage.functions import naming
from portage.sources import listing

_EMPTY = "path string, modificationTime timestamp, length bigint"


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Direct children of a directory with a known extension: name, path, parts, length, modified.

    A child is a file or a folder of part files under one file name. Spark lists the files itself; their content is not
    read.
    """
    base = storage.qualify(spark, directory)
    pattern = "*.{%s}" % ",".join(naming.EXTENSIONS)
    try:
        found = (
            spark.read.format("binaryFile")
            .load(storage.join(storage.glob_escape(base), pattern))
            .select("path", "modificationTime", "length")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], _EMPTY)
    relative = F.substring(F.col("path"), F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    return (
        found.select(F.substring_index(relative, "/", 1).alias("name"), "modificationTime", "length")
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.sum("length").alias("length"),
            F.max("modificationTime").alias("modified"),
        )
        .select("name", F.concat(F.lit(base.rstrip("/") + "/"), "name").alias("path"), "parts", "length", "modified")
    )


def stamped(manifest: DataFrame, template: str) -> DataFrame:
    """Entries whose name fits the template with a stamp that is a date."""
    return manifest.where(naming.is_stamped(F.col("name"), template))


def latest_name(manifest: DataFrame, template: str) -> DataFrame:
    """One row with the newest matching name, null without a match. Stamps have a fixed width, so names compare."""
    return stamped(manifest, template).agg(F.max("name").alias("name"))


def child_names(spark: SparkSession, directory: str, prefix: str = "", filesystem: dict | None = None) -> DataFrame:
    """name of each direct child whose name has the prefix; no folder of parts is entered.

    Executors list the directory. Where Arrow cannot open its scheme, Spark's own file index does, on the driver's JVM.
    """
    if storage.scheme(storage.qualify(spark, directory)) in listing.SCHEMES:
        return listing.list_names(spark, directory, prefix, filesystem).select("name")
    return list_files(spark, directory).select("name").where(F.col("name").startswith(prefix))


def find_latest(spark: SparkSession, path: str, filesystem: dict | None = None) -> str | None:
    """Newest file for a path whose last part holds a stamp token.

    Names stay rows on the executors: each task keeps the newest of its part of the directory, and the newest of these is
    the only name that reaches the driver.
    """
    template = storage.last_part(path)
    before = template.split(naming.token_of(template), 1)[0]
    return latest_name(child_names(spark, storage.parent(path), before, filesystem), template).first()["name"]


def names_by_extension(manifest: DataFrame) -> DataFrame:
    """Names with their extension, one row each, so that no row grows with the directory."""
    return manifest.select(naming.file_extension(F.col("name")).alias("extension"), "name")
