"""Ordered runs of transfers under one run id."""

from __future__ import annotations

from pyspark.sql import DataFrame

from portage.operators import runlog
from portage.plans.spec import TaskSpec
from portage.plans.transfers import TRANSFERS, RunContext

CONTINUE, STOP = "continue", "stop"


def run_tasks(context: RunContext, tasks: list[TaskSpec], on_failure: str = CONTINUE) -> DataFrame:
    """Run tasks in their order and return the status report of the run.

    The report is made in any case; ``on_failure="stop"`` leaves out the tasks after a failed one.
    """
    if on_failure not in (CONTINUE, STOP):
        raise ValueError(f"on_failure must be {CONTINUE} or {STOP}: {on_failure}")
    for task_order, task in enumerate(tasks):
        result = TRANSFERS[task.service](context, task, task_order)
        if not result.ok and on_failure == STOP:
            break
    return runlog.run_report(context.log.read(context.run_id, with_sequence=True), context.run_id)
