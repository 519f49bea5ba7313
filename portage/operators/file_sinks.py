"""File sinks that publish under an exact name.

``layout`` says what stands under the name, whatever the size of the result. ``parts``, the default, is a folder of parts
written in parallel, which every scan of this package, and of Spark, reads as one table. ``file`` is one file, which one
task reads and writes from end to end; it is for results that are known to stay small.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from portage import storage
from portage.functions import naming
from portage.operators.counting import RowCount, footer_rows

PARTS, FILE = "parts", "file"

# Microseconds and outer blanks would be lost with Spark's defaults for writing.
LOSSLESS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


@dataclass(frozen=True)
class Published:
    path: str
    name: str
    rows: int


def write_delimited(
    df: DataFrame, target: str, header: bool = True, delimiter: str = ",", layout: str = PARTS, **options: str
) -> Published:
    """Delimited text under an exact path, replacing what is there."""

    def write(rows: DataFrame, path: str, mode: str) -> None:
        rows.write.options(header=header, delimiter=delimiter, **{**LOSSLESS, **options}).mode(mode).csv(path)

    def recount(path: str) -> int:
        return df.sparkSession.read.schema(df.schema).options(header=header, delimiter=delimiter, **options).csv(path).count()

    return _publish(df, target, write, layout, recount)


def write_raw(
    df: DataFrame, target: str, header: bool = False, delimiter: str | None = None, layout: str = PARTS, **options: str
) -> Published:
    """Delimited text whose delimiter follows from the target's extension unless given, without a header line."""
    chosen = delimiter or ("\t" if naming.extension_of(target) == "txt" else ",")
    return write_delimited(df, target, header, chosen, layout, **options)


def write_parquet(df: DataFrame, target: str, layout: str = PARTS) -> Published:
    """Parquet under an exact path, replacing what is there."""

    def write(rows: DataFrame, path: str, mode: str) -> None:
        rows.write.mode(mode).parquet(path)

    return _publish(df, target, write, layout, lambda path: footer_rows(df, path), footers=True)


def _publish(
    df: DataFrame, target: str, write: Callable[[DataFrame, str, str], None], layout: str, recount: Callable[[str], int],
    footers: bool = False,
) -> Published:
    """Write beside the target, then put the result in its place; a failed write leaves the old result.

    Rows are counted by ``recount`` in the result if its files have them in ``footers``, or if the count that was observed
    while writing does not come.

    Where a rename copies all bytes, parts go straight to their final folder instead, whose old parts go when the new ones
    are committed; for that moment both are there.
    """
    if layout not in (PARTS, FILE):
        raise ValueError(f"layout is {PARTS} or {FILE}, not {layout!r}")
    spark = df.sparkSession
    target = storage.qualify(spark, target)
    token = uuid.uuid4().hex
    in_place = layout == PARTS and storage.scheme(target) in storage.RENAME_COPIES
    old_parts = []
    if in_place and storage.is_directory(spark, target):
        old_parts = storage.glob_names(spark, storage.join(storage.glob_escape(target), "*"))
    written = target if in_place else storage.join(storage.parent(target), f"_staging_{token}")
    placed = df.coalesce(1) if layout == FILE else df
    counted = None if footers else RowCount(placed)
    try:
        write(placed if footers else counted.df, written, "append" if old_parts else "overwrite")
        for name in old_parts:
            if name != "_SUCCESS":
                storage.delete(spark, storage.join(written, name))
        if layout == FILE:
            part = storage.glob_one(spark, storage.join(storage.glob_escape(written), "part-*"))
            _replace(spark, part, target, token)
        elif not in_place:
            _replace(spark, written, target, token)
    finally:
        if not in_place:
            storage.delete(spark, written)
    rows = None if footers else counted.reported()
    return Published(target, storage.last_part(target), recount(storage.glob_escape(target)) if rows is None else rows)


def _replace(spark: SparkSession, new: str, target: str, token: str) -> None:
    """Put a file or folder in the target's place; the old one goes only after the new one is next to it."""
    directory = storage.parent(target)
    ready, old = storage.join(directory, f"_ready_{token}"), storage.join(directory, f"_old_{token}")
    storage.rename(spark, new, ready)
    replaced = storage.exists(spark, target)
    if replaced:
        storage.rename(spark, target, old)
    storage.rename(spark, ready, target)
    if replaced:
        storage.delete(spark, old)
