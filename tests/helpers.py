"""Small shared pieces of the tests."""

from datetime import datetime

from portage.operators.runlog import RunLog
from portage.plans.spec import TaskSpec
from portage.plans.transfers import TRANSFERS, RunContext
from portage.sources.tables import TableAccess

RUN_TS = datetime(2024, 2, 1, 12, 30, 30)


def put(path, text=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def context(spark, tmp_path, **accesses):
    tables = {"warehouse": TableAccess(), **accesses}
    return RunContext(spark, RunLog(spark, f"file:{tmp_path}/run_log"), "daily", "run-1", tables, run_ts=RUN_TS)


def run(ctx, service, task_order=0, **params):
    return TRANSFERS[service](ctx, TaskSpec(service, {k: str(v) for k, v in params.items()}), task_order)


def audit(ctx):
    """Operation, item, count, target file and status of each log row, in order."""
    rows = ctx.log.read().orderBy("task_order", "operation").collect()
    return [(r.operation, r.source_file_dml, r.record_count, r.target_file, r.status) for r in rows]


def same_rows(left, right):
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
