"""Row counts of what a sink has committed.

A finished load is never a failed one because a count is missing: where nothing tells it, it is None. Where the sink's own
result can tell, it is asked: Parquet footers hold the rows of each committed file, and a table command sums the rows of
the tasks whose files it took. Else the rows are observed while they are written.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Metrics arrive a moment after their action; a lost one never does.
_WAIT_SECONDS = 10


class RowCount:
    """Counts the rows of ``df`` while the next action on it runs.

    Put it right below the sink. Then it counts in the last stage, where a task that runs again after a lost executor
    is counted once.
    """

    def __init__(self, df: DataFrame):
        self._observation = Observation()
        self.df = df.observe(self._observation, F.count(F.lit(1)).alias("rows"))

    def reported(self) -> int | None:
        """The count, or None if it does not come."""
        until = time.monotonic() + _WAIT_SECONDS
        while not self._observation._jo.getRowOrEmpty().isDefined():
            if time.monotonic() > until:
                return None
            time.sleep(0.01)
        return self._observation.get["rows"]


def footer_rows(df: DataFrame, path: str) -> int:
    """Rows in the Parquet files of a folder; no column is read, so only their footers are."""
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def committed_rows(command: DataFrame) -> int | None:
    """Rows that an INSERT, which has run as a command, took from its tasks. None for sinks that do not say."""
    plan = command._jdf.queryExecution().commandExecuted().commandPhysicalPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    rows = plan.metrics().get("numOutputRows")
    return rows.get().value() if rows.isDefined() else None
