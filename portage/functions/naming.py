"""File names, stamps and defaults as Column expressions, so that one rule serves a single name and a whole listing."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Tokens a user may put in a path, their Spark date patterns, and the file extensions that are handled.
DATETIME_TOKEN = "yyyymmddHHMMSS"
DATE_TOKEN = "yyyymmdd"
STAMP_FORMATS = {DATETIME_TOKEN: "yyyyMMddHHmmss", DATE_TOKEN: "yyyyMMdd"}
EXTENSIONS = ("txt", "csv", "parquet")


def token_of(name: str) -> str | None:
    """Stamp token in a name; the longer one is looked for first since it starts with the shorter."""
    return next((token for token in (DATETIME_TOKEN, DATE_TOKEN) if token in name), None)


def has_known_extension(name: str) -> bool:
    return name.endswith(tuple(f".{extension}" for extension in EXTENSIONS))


def extension_of(name: str) -> str:
    return name.rsplit(".", 1)[-1] if "." in name else ""


def stamp_regex(template: str) -> str:
    """Whole-name pattern for a template; the stamp is group 1 and everything else is literal."""
    token = token_of(template)
    before, after = template.split(token, 1)
    return rf"^{re.escape(before)}(\d{{{len(token)}}}){re.escape(after)}\z"


def split_path(path: Column) -> Column:
    """Struct of scheme, bucket, prefix and file; a path without a scheme has no bucket."""
    parts = F.split(path, "/")
    has_scheme = path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    skipped = F.when(has_scheme, F.lit(3)).otherwise(F.lit(0))
    middle = F.greatest(F.size(parts) - skipped - 1, F.lit(0))
    return F.struct(
        F.regexp_extract(path, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("scheme"),
        F.when(has_scheme, F.get(parts, F.lit(2))).otherwise(F.lit("")).alias("bucket"),
        F.array_join(F.slice(parts, skipped + 1, middle), "/").alias("prefix"),
        F.element_at(parts, -1).alias("file"),
    )


def file_extension(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^./]+)$", 1)


def base_name(name: Column) -> Column:
    """Part before the last underscore, empty where there is none."""
    return F.regexp_extract(name, "(?s)^(.*)_[^_]*$", 1)


def date_stamp(run_ts: Column) -> Column:
    return F.substring(datetime_stamp(run_ts), 1, len(DATE_TOKEN))


def datetime_stamp(run_ts: Column) -> Column:
    """Digits of the wall-clock time. As text, since a formatter would move times that a zone's clock leaves out."""
    return F.regexp_replace(F.substring(run_ts.cast("timestamp_ntz").cast("string"), 1, 19), "[^0-9]", "")


def stamp_name(name: Column, run_ts: Column) -> Column:
    """Name with its tokens replaced by the run date or datetime."""
    dated = F.replace(name, F.lit(f"_{DATETIME_TOKEN}"), F.concat(F.lit("_"), datetime_stamp(run_ts)))
    return F.replace(dated, F.lit(f"_{DATE_TOKEN}"), F.concat(F.lit("_"), date_stamp(run_ts)))


def table_file_name(table: Column, run_ts: Column) -> Column:
    """Default file name for a table: its last dotted part, the datetime and ``.csv``."""
    return F.concat(F.element_at(F.split(table, r"\."), -1), F.lit("_"), datetime_stamp(run_ts), F.lit(".csv"))


def target_file_name(target: Column, source_name: Column, run_ts: Column) -> Column:
    """Stamped name from the target, or the source's name where the target is a directory."""
    known = target.rlike(r"\.(%s)$" % "|".join(EXTENSIONS))
    return F.when(known, stamp_name(F.substring_index(target, "/", -1), run_ts)).otherwise(source_name)


def delimiter_for(name: Column) -> Column:
    return F.when(file_extension(name) == "txt", F.lit("\t")).otherwise(F.lit(","))


def default_if_blank(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def split_list(value: Column) -> Column:
    """Comma list as an array of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(value, ","), lambda item: F.trim(item)), lambda item: item != "")


def is_stamped(name: Column, template: str) -> Column:
    """Does the name fit the template, and is its stamp a possible date?"""
    pattern = stamp_regex(template)
    stamp = F.regexp_extract(name, pattern, 1)
    return name.rlike(pattern) & F.try_to_timestamp(stamp, F.lit(STAMP_FORMATS[token_of(template)])).isNotNull()


def as_run_ts(run_ts: datetime) -> Column:
    """A clock value as a wall-clock literal, whatever the time zones of Python and of the session."""
    return F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")


def evaluate(spark: SparkSession, expression: Column):
    """Value of an expression without input columns; the optimizer folds it, so no job runs."""
    return spark.sql("VALUES (0)").select(expression.alias("value")).first()["value"]
