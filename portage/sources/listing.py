"""Names in one directory as a partitioned source of Spark: ``spark.read.format("portage_listing")``.

A directory of more than a page of names is split into ranges of names, with about equally many in each by the first page.
Each range is a partition, which one task reads in pages, so a wide directory is many tasks' work and no list of its names
is held by the driver. Where the store itself can't start in the middle, a task passes over the names of other ranges; it
asks for the sizes and times of its own only.
"""

from __future__ import annotations

import itertools
import json
import sys
import weakref
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from portage import storage
from portage.operators import arrow_tasks

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrow_tasks)

FORMAT = "portage_listing"
SCHEMA = "name string, path string, length bigint, modified timestamp, is_directory boolean"
#: Names of a page, and ranges of a directory that has more.
PAGE, RANGES = 10000, 8
# Schemes that the Arrow file systems of the tasks open (fixed values).
SCHEMES = frozenset({"file", "s3", "s3a", "s3n", "hdfs", "gs"})


@dataclass
class NameRange(InputPartition):
    """Names from ``low`` on and below ``high``; None is no bound."""

    low: str | None
    high: str | None


def ranges_of(page: list[str], whole: bool, ranges: int) -> list[NameRange]:
    """Ranges that hold every name exactly once, from the first names that came; one range if these were all."""
    if whole:
        return [NameRange(None, None)]
    ordered = sorted(page)
    bounds = sorted({ordered[i * len(ordered) // ranges] for i in range(1, ranges)})
    return [NameRange(low, high) for low, high in zip([None, *bounds], [*bounds, None])]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory, self.prefix = options["path"], options.get("prefix", "")
        self.page, self.ranges = int(options.get("page", PAGE)), int(options.get("ranges", RANGES))
        self.filesystem = json.loads(options.get("filesystem", "{}"))

    def _entries(self, within: NameRange) -> Iterator[tuple]:
        low, high, prefix = within.low, within.high, self.prefix

        def wanted(name: str) -> bool:
            return name.startswith(prefix) and (low is None or name >= low) and (high is None or name < high)

        try:
            yield from arrow_tasks.children(self.directory, self.filesystem, wanted)
        except FileNotFoundError:
            return

    def partitions(self) -> list[NameRange]:
        first = [entry[0] for entry in itertools.islice(self._entries(NameRange(None, None)), self.page + 1)]
        return ranges_of(first, len(first) <= self.page, self.ranges)

    def read(self, partition: NameRange) -> Iterator[pa.RecordBatch]:
        entries = self._entries(partition)
        while page := list(itertools.islice(entries, self.page)):
            names, lengths, times, folders = zip(*page)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([f"{self.directory.rstrip('/')}/{name}" for name in names], pa.string()),
                    pa.array(lengths, pa.int64()),
                    pa.array([None if t is None else datetime.fromtimestamp(t, timezone.utc) for t in times], pa.timestamp("us", "UTC")),
                    pa.array(folders, pa.bool_()),
                ],
                names=["name", "path", "length", "modified", "is_directory"],
            )


class Listing(DataSource):
    """Options: ``path``, a qualified directory; ``prefix`` of the names; ``page``; ``ranges``; ``filesystem``, JSON."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


_registered: weakref.WeakSet = weakref.WeakSet()


def list_names(
    spark: SparkSession, directory: str, prefix: str = "", filesystem: dict | None = None, ranges: int = RANGES, page: int = PAGE
) -> DataFrame:
    """name, path, length, modified and is_directory of every direct child of a directory whose name has the prefix.

    A directory that isn't there has none. The directory's scheme is one of ``SCHEMES``; ``filesystem`` are options for its
    Arrow file system.
    """
    if spark not in _registered:
        spark.dataSource.register(Listing)
        _registered.add(spark)
    options = {"prefix": prefix, "ranges": str(ranges), "page": str(page), "filesystem": json.dumps(filesystem or {})}
    return spark.read.format(FORMAT).options(**options).load(storage.qualify(spark, directory))
