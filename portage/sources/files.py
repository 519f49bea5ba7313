"""Scans of delimited and Parquet files: one file, the newest of a series, or a whole directory."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from portage import storage
from portage.functions import naming
from portage.operators import arrow_tasks
from portage.session import stored
from portage.sources import listing, manifest

MULTIPLE_FILES = "MultipleFiles"
REJECTED_LINE, SOURCE_FILE = "rejected_line", "source_file"
#: Different header lines that the text files of one directory may have.
MOST_HEADERS = 100
# Spark's defaults would read values under wrong names, as nulls, or not at all, and say nothing.
STRICT = {"mode": "FAILFAST", "enforceSchema": "false"}


@dataclass(frozen=True)
class FileScan:
    """A scan, the file it reads (``MultipleFiles`` for a directory), and for a directory its names, one row each."""

    df: DataFrame
    name: str
    names: DataFrame | None = None


def scan_delimited(
    spark: SparkSession,
    *paths: str,
    header: bool = True,
    delimiter: str = ",",
    schema: StructType | str | None = None,
    sampling_ratio: float | None = None,
    infer: bool = True,
    **options: str,
) -> DataFrame:
    """Delimited text. Without a schema, types are inferred by a pass over the data, or all are strings.

    A line with more or fewer values than columns, or with a value of another type, is an error, and so is a header
    line that names other columns than the schema. ``mode`` or ``enforceSchema`` among the options change that.
    """
    reader = spark.read.options(header=header, delimiter=delimiter, **{**STRICT, **options})
    if schema is not None:
        return reader.schema(schema).csv(list(paths))
    reader = reader.option("inferSchema", infer)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.csv(list(paths))


def scan_with_rejects(
    spark: SparkSession, *paths: str, schema: StructType | str, header: bool = True, delimiter: str = ",", **options: str
) -> DataFrame:
    """The same, with ``REJECTED_LINE``: null, or the text of a line that has other values than the schema's columns.

    ``source_file`` is the file of each line. A header line must still name the schema's columns.
    """
    columns = spark.createDataFrame([], schema).schema
    if {REJECTED_LINE, SOURCE_FILE} & {column.name.lower() for column in columns}:
        raise ValueError(f"columns cannot be named {REJECTED_LINE} or {SOURCE_FILE} where lines are rejected")
    chosen = {**STRICT, **options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED_LINE}
    reader = spark.read.options(header=header, delimiter=delimiter, **chosen)
    rows = reader.schema(StructType([*columns, StructField(REJECTED_LINE, StringType())])).csv(list(paths))
    return rows.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))


def scan_raw(
    spark: SparkSession, path: str, header: bool = False, delimiter: str | None = None, **options: str
) -> DataFrame:
    """Delimited text with all values as strings; without ``header`` the first line is a row like any other.

    The delimiter follows from the extension unless given. A line with another number of values than the first is an error.
    """
    chosen = delimiter or ("\t" if naming.extension_of(path) == "txt" else ",")
    return spark.read.options(header=header, delimiter=chosen, **{**STRICT, **options}).csv(path)


def scan_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def scan_directory(spark: SparkSession, directory: str, filesystem: dict | None = None, **csv_options) -> DataFrame:
    """All known files directly in a directory as one table; nested directories are left out.

    Columns are added by name. Text files with the same header line share one reader; where header lines name the columns
    in several orders, each order has a reader of its own, which checks it.
    """
    base = storage.glob_escape(storage.qualify(spark, directory))
    text, columnar = storage.join(base, "*.{csv,txt}"), storage.join(base, "*.parquet")
    extension = naming.file_extension(F.col("name")).alias("extension")
    names = manifest.child_names(spark, directory, filesystem=filesystem).select(extension)
    kinds = {row["extension"] for row in names.where(F.col("extension").isin(*naming.EXTENSIONS)).distinct().collect()}
    scans = []
    if kinds & {"csv", "txt"}:
        scans += _scan_text_by_header(spark, directory, text, filesystem, csv_options)
    if "parquet" in kinds:
        scans.append(scan_parquet(spark, columnar))
    if not scans:
        raise FileNotFoundError(f"no text or Parquet files in {directory}")
    return reduce(DataFrame.unionByName, scans)


def header_index(spark: SparkSession, directory: str, filesystem: dict | None = None) -> DataFrame:
    """path and header of each text file directly in a directory; executors read one line of each. Empty files have none."""
    names = listing.list_names(spark, directory, filesystem=filesystem)
    texts = names.where(naming.file_extension(F.col("name")).isin("csv", "txt")).select("path", "is_directory")
    first = arrow_tasks.header_lines
    return texts.mapInArrow(lambda batches: first(batches, filesystem or {}), "path string, header string").where("header IS NOT NULL")


def _scan_text_by_header(
    spark: SparkSession, directory: str, pattern: str, filesystem: dict | None, csv_options: dict
) -> list[DataFrame]:
    """One scan for each header line that there is among a directory's text files."""
    listed = storage.scheme(storage.qualify(spark, directory)) in listing.SCHEMES
    if not listed or not csv_options.get("header", True) or csv_options.get("enforceSchema", "false") == "true":
        return [scan_delimited(spark, pattern, **csv_options)]
    index = stored(header_index(spark, directory, filesystem), "headers")
    headers = [row["header"] for row in index.groupBy("header").agg(F.min("path").alias("first")).orderBy("first").limit(
        MOST_HEADERS + 1).collect()]
    if len(headers) <= 1:
        return [scan_delimited(spark, pattern, **csv_options)]
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"files in {directory} have more than {MOST_HEADERS} header lines")
    scans, schema = [], csv_options.pop("schema", None)
    wanted = spark.createDataFrame([], schema).schema if schema is not None else None
    for header in headers:
        # Spark takes the files of a scan from the driver in any case, which holds their names.
        paths = [storage.glob_escape(row["path"]) for row in index.where(F.col("header") == header).toLocalIterator()]
        own = None if wanted is None else _in_order_of(wanted, header, csv_options)
        scan = scan_delimited(spark, *paths, schema=own, **csv_options)
        scans.append(scan if wanted is None else scan.select(*(F.col(quoted(name)) for name in wanted.names)))
    return scans


def _in_order_of(schema: StructType, header: str, csv_options: dict) -> StructType:
    """The schema's columns in the order in which a header line names them."""
    quote = csv_options.get("quote", '"')
    names = next(csv.reader([header], delimiter=csv_options.get("delimiter", ","), quotechar=quote or None))
    by_name = {column.name.lower(): column for column in schema}
    if sorted(name.lower() for name in names) != sorted(by_name):
        raise ValueError(f"the header line {header!r} names other columns than the schema")
    return StructType([by_name[name.lower()] for name in names])


def quoted(name: str) -> str:
    return "`{}`".format(name.replace("`", "``"))


def with_source_file(df: DataFrame) -> DataFrame:
    """File scan with the name of the file, or folder of parts, that each row comes from."""
    name = r"([^/]+\.(?:%s))(?:/part-[^/]*)?$" % "|".join(naming.EXTENSIONS)
    # The path is percent-encoded, but with its plus signs as they are.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select("*", F.regexp_extract(path, name, 1).alias("source_file"))


def resolve(spark: SparkSession, path: str, filesystem: dict | None = None) -> str:
    """Exact path of one file: the path itself, or the newest file where its name holds a stamp token."""
    name = storage.last_part(path)
    if naming.token_of(name):
        name = manifest.find_latest(spark, path, filesystem)
        if name is None:
            raise FileNotFoundError(f"no file fits {path}")
        return storage.join(storage.parent(path), name)
    if not storage.exists(spark, path):
        raise FileNotFoundError(path)
    return path


def scan_file(spark: SparkSession, path: str, filesystem: dict | None = None, **csv_options) -> FileScan:
    """Scan an exact path, the newest file of a series, or a directory."""
    if not naming.has_known_extension(path):
        return FileScan(scan_directory(spark, path, filesystem, **csv_options), MULTIPLE_FILES, directory_names(spark, path))
    exact = resolve(spark, path, filesystem)
    name = storage.last_part(exact)
    readable = storage.glob_escape(exact)
    if naming.extension_of(name) == "parquet":
        return FileScan(scan_parquet(spark, readable), name)
    return FileScan(scan_delimited(spark, readable, **csv_options), name)


def directory_names(spark: SparkSession, directory: str) -> DataFrame:
    """Names of the files that ``scan_directory`` reads, one row each (source_file). No job runs before it is used."""
    return manifest.list_files(spark, directory).select(F.col("name").alias("source_file"))
