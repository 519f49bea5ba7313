"""Metadata calls on Hadoop file systems: exists, rename, delete, sizes. No data goes through here."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Schemes on which a rename copies every byte (fixed values).
RENAME_COPIES = frozenset({"s3", "s3a", "s3n", "gs", "oss", "cosn"})


def _handles(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualify(spark: SparkSession, path: str) -> str:
    """Path with its scheme, so that Spark and Arrow mean the same place by it."""
    hadoop_path, fs = _handles(spark, path)
    return fs.makeQualified(hadoop_path).toString()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _handles(spark, path)
    return fs.exists(hadoop_path)


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _handles(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def make_directory(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _handles(spark, path)
    fs.mkdirs(hadoop_path)


def rename(spark: SparkSession, source: str, target: str) -> None:
    source_path, fs = _handles(spark, source)
    target_path, _ = _handles(spark, target)
    if not fs.rename(source_path, target_path):
        raise OSError(f"cannot rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _handles(spark, path)
    fs.delete(hadoop_path, True)


def glob_one(spark: SparkSession, pattern: str) -> str:
    """The path that a pattern with a single match stands for."""
    found = _glob(spark, pattern)
    if len(found) != 1:
        raise OSError(f"{pattern} matches {len(found)} paths, not one")
    return found[0].getPath().toString()


def glob_names(spark: SparkSession, pattern: str) -> list[str]:
    return [status.getPath().getName() for status in _glob(spark, pattern)]


def _glob(spark: SparkSession, pattern: str):
    hadoop_path, fs = _handles(spark, pattern)
    return fs.globStatus(hadoop_path) or []


def glob_escape(path: str) -> str:
    """Literal form of a path for readers that expand globs."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scheme(path: str) -> str:
    return path.split(":", 1)[0].lower() if ":" in path else ""


def join(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}"


def parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0]


def last_part(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]
