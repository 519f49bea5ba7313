"""The five transfers. Each resolves its source, writes and counts in one pass, and leaves rows in the run log."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage import storage
from portage.functions import naming
from portage.operators import copying, file_sinks, rejects, table_sinks
from portage.operators.rejects import Split
from portage.operators.runlog import FAILED, SUCCESS, AuditRow, RunLog
from portage.plans import spec
from portage.plans.spec import TaskSpec
from portage.sources import files, tables
from portage.sources.tables import Partitioning, TableAccess

logger = logging.getLogger(__name__)

MULTIPLE_FILES = "Multiple files"
FAIL, REJECT = "fail", "reject"


@dataclass(frozen=True)
class RunContext:
    """What the tasks of one run share.

    ``tables`` maps access names to databases, ``filesystems`` to Arrow options for bulk copies. ``run_ts`` stamps names
    and log rows; without it the session's clock does.
    """

    spark: SparkSession
    log: RunLog
    pipeline: str
    run_id: str
    tables: dict[str, TableAccess] = field(default_factory=dict)
    filesystems: dict[str, dict] = field(default_factory=dict)
    run_ts: datetime | None = None

    def clock(self) -> datetime:
        return self.run_ts or naming.evaluate(self.spark, F.current_timestamp().cast("timestamp_ntz"))

    def table_access(self, name: str) -> TableAccess:
        if name not in self.tables:
            raise LookupError(f"no database access named {name!r}")
        return self.tables[name]


@dataclass(frozen=True)
class TransferResult:
    """Outcome of a transfer: rows moved (objects for a copy) and the target's full path or table."""

    ok: bool
    records: int | None = 0
    target: str = ""
    error: str = ""


@dataclass(frozen=True)
class _Audit:
    """Log rows of one task."""

    context: RunContext
    task: TaskSpec
    task_order: int
    source_access: str
    source: str
    target_access: str
    target: str

    def row(
        self, operation: str, status: str, records: int | None = 0, source_item: str = "", target_file: str = ""
    ) -> AuditRow:
        return AuditRow(
            self.context.pipeline, self.context.run_id, spec.service_code(self.task.service), self.task_order,
            self.source_access, self.source, source_item, operation, records,
            self.target_access, self.target, target_file, status,
        )

    def append(self, *rows: AuditRow) -> None:
        self.context.log.append(*rows, at=self.context.run_ts)

    def failed(self, operation: str, error: Exception, source_item: str = "") -> TransferResult:
        logger.error("%s failed to %s: %s", self.task.service, operation, error)
        rows = [self.row(operation, FAILED, source_item=source_item)]
        if operation == "write":  # the source was found; how many rows it has is not known
            rows.insert(0, self.row("read", SUCCESS, None, source_item))
        self.append(*rows)
        return TransferResult(False, error=str(error))

    def moved(
        self, records: int | None, source_item: str, written_item: str, target: str, target_file: str = "",
        rejected: int | None = None,
    ) -> TransferResult:
        """One pass has read and written the rows, so both operations have the same count, or none if it is not known.

        Lines that were ``rejected`` were read too, and have a row of their own with the folder that holds them.
        """
        read = records if records is None or rejected is None else records + rejected
        rows = [
            self.row("read", SUCCESS, read, source_item),
            self.row("write", SUCCESS, records, written_item, target_file),
        ]
        if rejected is not None:
            rows.insert(1, self.row("reject", SUCCESS, rejected, source_item, self.task.get("rejects_path")))
        self.append(*rows)
        return TransferResult(True, records, target)


def _audit(context: RunContext, task: TaskSpec, task_order: int, source: tuple[str, str], target: tuple[str, str]):
    return _Audit(
        context, task, task_order, task.get(source[0]), task.get(source[1]), task.get(target[0]), task.get(target[1])
    )


def _text_options(task: TaskSpec) -> dict[str, str]:
    """Spark options for text files, given as ``csv_<option>``; they hold for reading and writing."""
    return {key[len("csv_"):]: value for key, value in task.params.items() if key.startswith("csv_")}


def _has_header(task: TaskSpec) -> bool:
    return task.get("header_row", "True").lower() == "true"


def _scan_options(task: TaskSpec) -> dict:
    """Reader options of a task: header, delimiter, schema, sampling."""
    options: dict = {"header": _has_header(task), "delimiter": task.get("file_delimiter", ","), **_text_options(task)}
    if task.get("schema"):
        options["schema"] = task.get("schema")
    if task.get("sampling_ratio"):
        options["sampling_ratio"] = float(task.get("sampling_ratio"))
    return options


def _rejects_lines(task: TaskSpec) -> bool:
    """``on_bad_lines``: ``fail`` (the default), or ``reject`` to keep them in ``rejects_path`` and go on."""
    chosen = task.get("on_bad_lines", FAIL)
    if chosen not in (FAIL, REJECT):
        raise ValueError(f"on_bad_lines is {FAIL} or {REJECT}, not {chosen!r}")
    if chosen == REJECT and not task.get("rejects_path"):
        raise ValueError("on_bad_lines=reject needs a rejects_path")
    return chosen == REJECT


def _split_source(context: RunContext, task: TaskSpec, task_order: int, path: str, schema, options: dict) -> Split:
    """Good rows of a text file, whose bad lines are kept under the run and the task."""
    split = rejects.split_rejects(files.scan_with_rejects(context.spark, storage.glob_escape(path), schema=schema, **options))
    if split.rejected_rows:
        rejects.write_rejects(split.rejected, task.get("rejects_path"), context.run_id, task_order)
    return split


def _layout(task: TaskSpec) -> dict[str, str]:
    """``layout``: a folder of ``parts`` (the default) or one ``file``."""
    return {"layout": task.get("layout", file_sinks.PARTS)}


def _partitioning(task: TaskSpec) -> Partitioning | None:
    """``predicates``, a JSON list, or ranges of ``partition_column``."""
    if task.get("predicates"):
        return Partitioning(predicates=tuple(json.loads(task.get("predicates"))))
    column = task.get("partition_column")
    if not column:
        return None
    lower, upper = task.get("lower_bound") or None, task.get("upper_bound") or None
    even, sampled = (task.get(name).lower() == "true" for name in ("partition_even", "partition_sampled"))
    return Partitioning(
        column, int(task.get("num_partitions", "1")), lower, upper, even, sampled, task.get("partition_second_column"))


def _scan_source_table(context: RunContext, task: TaskSpec):
    access = context.table_access(task.get("source_access_db"))
    single = task.get("single_connection").lower() == "true"
    partitioning = _partitioning(task)
    if single and partitioning is not None:
        raise ValueError("single_connection=true and a partitioning exclude each other")
    return tables.scan_table(context.spark, access, task.get("source_table"), task.get("dml"), partitioning, single)


def _load_target_table(context: RunContext, task: TaskSpec, df) -> int | None:
    access = context.table_access(task.get("target_access_db"))
    truncate = task.get("truncate").lower() == "true"
    tuning = {
        "num_partitions": int(task.get("write_partitions")) if task.get("write_partitions") else None,
        "batch_size": int(task.get("batch_size")) if task.get("batch_size") else None,
        "column_types": task.get("column_types") or None,
    }
    tuning = {name: value for name, value in tuning.items() if value is not None}
    return table_sinks.load_table(df, access, task.get("target_table"), task.get("load_type", "Append"), truncate, **tuning)


def _typed_like_target(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns with the types that the target table has for their names; a value that does not fit is an error."""
    types = {column.name.lower(): column.dataType for column in target.schema}
    columns = {name: F.col("`{}`".format(name.replace("`", "``"))) for name in df.columns}
    return df.select(
        *(column.cast(types[name.lower()]).alias(name) if name.lower() in types else column
          for name, column in columns.items())
    )


def _source_query(task: TaskSpec) -> str:
    return tables.query_text(task.get("source_table"), task.get("dml"))


def file_to_table(context: RunContext, task: TaskSpec, task_order: int) -> TransferResult:
    """Load one file, the newest of a series, or a directory into a table.

    Text that is appended to a table that is there takes its types, which spares the pass that infers them, unless a
    ``schema`` is given. ``types_from_target`` says so, or not, for all loads. The names of a directory's files go to
    the log's table of source files. With ``on_bad_lines=reject``, lines of one text file that do not fit its columns are
    kept apart and counted in the log.
    """
    audit = _audit(
        context, task, task_order, ("source_s3_access", "source_s3_file_path"), ("target_access_db", "target_table")
    )
    try:
        spark, access = context.spark, context.table_access(audit.target_access)
        split, filesystem = None, context.filesystems.get(audit.source_access)
        appended = table_sinks.load_mode(task.get("load_type")) == table_sinks.APPEND
        default = str(appended and not task.get("schema"))
        typed = task.get("types_from_target", default).lower() == "true" and tables.table_exists(spark, access, audit.target)
        scan = files.scan_file(spark, audit.source, filesystem, infer=not typed, **_scan_options(task))
        df = _typed_like_target(scan.df, tables.scan_table(spark, access, audit.target)) if typed else scan.df
        if _rejects_lines(task) and naming.extension_of(scan.name) in ("csv", "txt"):
            exact = storage.join(storage.parent(audit.source), scan.name)
            options = {name: value for name, value in _scan_options(task).items() if name not in ("schema", "sampling_ratio")}
            split = _split_source(context, task, task_order, exact, df.schema, options)
            df = split.good
        if scan.names is not None:
            context.log.append_source_files(context.run_id, task_order, scan.names)
    except Exception as error:
        return audit.failed("read", error)
    try:
        rows = _load_target_table(context, task, df)
    except Exception as error:
        return audit.failed("write", error, scan.name)
    return audit.moved(rows, scan.name, scan.name, audit.target, rejected=split and split.rejected_rows)


def table_to_file(context: RunContext, task: TaskSpec, task_order: int) -> TransferResult:
    """Write a table, or the result of a query on it, to a file."""
    audit = _audit(
        context, task, task_order, ("source_access_db", "source_table"), ("target_s3_access", "target_s3_file_path")
    )
    query = _source_query(task)
    try:
        df = _scan_source_table(context, task)
    except Exception as error:
        return audit.failed("read", error, query)
    try:
        clock = naming.as_run_ts(context.clock())
        default = naming.table_file_name(F.lit(audit.source), clock)
        path = _target_path(context, audit.target, default, clock)
        if naming.extension_of(path) == "parquet":
            published = file_sinks.write_parquet(df, path, **_layout(task))
        else:
            options = {"delimiter": task.get("target_file_delimiter", ","), **_layout(task), **_text_options(task)}
            published = file_sinks.write_delimited(df, path, **options)
    except Exception as error:
        return audit.failed("write", error, query)
    return audit.moved(published.rows, query, query, published.path, published.name)


def landing_to_file(context: RunContext, task: TaskSpec, task_order: int) -> TransferResult:
    """Bring a file of a landing directory to its target, in the format that the target's extension names.

    Values of text files stay the strings they are. ``header_row``, true unless set, says that the first line holds
    names: it is kept but not counted, and a target of many parts has it in each.
    """
    audit = _audit(
        context, task, task_order,
        ("source_sftp_access", "source_sftp_file_path"), ("target_s3_access", "target_s3_file_path"),
    )
    header, options, split = _has_header(task), _text_options(task), None
    filesystem = context.filesystems.get(audit.source_access)
    try:
        if not naming.has_known_extension(audit.source):
            raise ValueError(f"a landing path names one file, or the newest of a series: {audit.source}")
        exact = files.resolve(context.spark, audit.source, filesystem)
        name = storage.last_part(exact)
        if naming.extension_of(name) == "parquet":
            df = files.scan_parquet(context.spark, storage.glob_escape(exact))
        else:
            df = files.scan_raw(context.spark, storage.glob_escape(exact), header, **options)
            if _rejects_lines(task):
                raw = {"header": header, "delimiter": "\t" if naming.extension_of(name) == "txt" else ",", **options}
                split = _split_source(context, task, task_order, exact, df.schema, raw)
                df = split.good
    except Exception as error:
        return audit.failed("read", error)
    try:
        path = _target_path(context, audit.target, F.lit(name), naming.as_run_ts(context.clock()))
        if naming.extension_of(path) == "parquet":
            published = file_sinks.write_parquet(df, path, **_layout(task))
        else:
            published = file_sinks.write_raw(df, path, header, **_layout(task), **options)
    except Exception as error:
        return audit.failed("write", error, name)
    rejected = split and split.rejected_rows
    return audit.moved(published.rows, name, name, published.path, published.name, rejected)


def table_to_table(context: RunContext, task: TaskSpec, task_order: int) -> TransferResult:
    """Load a table, or the result of a query on it, into another table."""
    audit = _audit(
        context, task, task_order, ("source_access_db", "source_table"), ("target_access_db", "target_table")
    )
    query = _source_query(task)
    try:
        df = _scan_source_table(context, task)
    except Exception as error:
        return audit.failed("read", error, query)
    try:
        rows = _load_target_table(context, task, df)
    except Exception as error:
        return audit.failed("write", error, query)
    return audit.moved(rows, query, query, audit.target)


def file_to_file(context: RunContext, task: TaskSpec, task_order: int) -> TransferResult:
    """Copy one file, the newest of a series, or a directory tree, byte for byte. The count is of objects."""
    audit = _audit(
        context, task, task_order,
        ("source_s3_access", "source_s3_file_path"), ("target_s3_access", "target_s3_file_path"),
    )
    options = [context.filesystems.get(name, {}) for name in (audit.source_access, audit.target_access)]
    try:
        if not naming.has_known_extension(audit.source):
            copied = copying.copy_tree(context.spark, audit.source, audit.target, *options)
            if not copied.objects:
                raise FileNotFoundError(f"no files in {audit.source}")
            target, shown = audit.target, MULTIPLE_FILES
        else:
            exact = files.resolve(context.spark, audit.source, context.filesystems.get(audit.source_access))
            clock = naming.as_run_ts(context.clock())
            target = _target_path(context, audit.target, F.lit(storage.last_part(exact)), clock)
            copied, shown = copying.copy_file(context.spark, exact, target, *options), storage.last_part(target)
    except Exception as error:
        return audit.failed("copy", error)
    audit.append(audit.row("copy", SUCCESS, copied.objects, target_file=shown))
    return TransferResult(True, copied.objects, target)


def _target_path(context: RunContext, target: str, default_name, clock) -> str:
    """Full target path with a stamped name; a target directory gets the default name."""
    name = naming.evaluate(context.spark, naming.target_file_name(F.lit(target), default_name, clock))
    directory = storage.parent(target) if naming.has_known_extension(target) else target
    return storage.join(directory, name)


TRANSFERS: dict[str, Callable[[RunContext, TaskSpec, int], TransferResult]] = {
    spec.FILE_TO_TABLE: file_to_table,
    spec.TABLE_TO_FILE: table_to_file,
    spec.FILE_TO_FILE: file_to_file,
    spec.LANDING_TO_FILE: landing_to_file,
    spec.TABLE_TO_TABLE: table_to_table,
}
