"""What a user writes down: tasks, their parameters, and pipelines of tasks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from portage.operators import registry

# The services by their form names.
FILE_TO_TABLE = "S3 to DB"
TABLE_TO_FILE = "DB to S3"
FILE_TO_FILE = "S3 to S3"
LANDING_TO_FILE = "SFTP to S3"
TABLE_TO_TABLE = "DB to DB"
SERVICES = (FILE_TO_TABLE, TABLE_TO_FILE, FILE_TO_FILE, LANDING_TO_FILE, TABLE_TO_TABLE)


def service_code(service: str) -> str:
    """Name of a service in the run log, such as ``S3-DB``."""
    return service.replace(" to ", "-")


@dataclass(frozen=True)
class TaskSpec:
    """One transfer: its service and its parameters, all strings."""

    service: str
    params: dict[str, str]

    def __post_init__(self):
        if self.service not in SERVICES:
            raise ValueError(f"unknown service: {self.service}")

    def get(self, name: str, default: str = "") -> str:
        """A parameter; an empty one counts as left out."""
        return self.params.get(name) or default

    @staticmethod
    def from_form(form: dict[str, str], number: int) -> TaskSpec:
        """Task of a form whose keys end in ``_<number>``."""
        suffix = f"_{number}"
        params = {key[: -len(suffix)]: value for key, value in form.items() if key.endswith(suffix)}
        return TaskSpec(params.pop("select_service"), params)


@dataclass(frozen=True)
class PipelineSpec:
    """Tasks in their order, under a name."""

    name: str
    tasks: list[TaskSpec]
    recipients: list[str] = field(default_factory=list)
    cron_schedule: str = ""

    @staticmethod
    def from_form(name: str, form: dict[str, str], recipients: str = "", cron_schedule: str = "") -> PipelineSpec:
        """All tasks of a form, by their numbers."""
        chosen = (re.fullmatch(r"select_service_(\d+)", key) for key in form)
        numbers = sorted(int(match.group(1)) for match in chosen if match)
        addresses = [part.strip() for part in recipients.split(",") if part.strip()]
        return PipelineSpec(name, [TaskSpec.from_form(form, n) for n in numbers], addresses, cron_schedule)

    def to_row(self, spark: SparkSession) -> DataFrame:
        """The pipeline as a row for the registry."""
        tasks = [(task.service, task.params) for task in self.tasks]
        return spark.createDataFrame(
            [(self.name, ",".join(self.recipients), self.cron_schedule, tasks)],
            "pipeline_name string, notification_recipients string, cron_schedule string, services " + registry.TASKS,
        ).coalesce(1)


def load_pipeline(pipelines: DataFrame, name: str) -> PipelineSpec:
    """The newest pipeline of a name in the registry."""
    newest = pipelines.where(pipelines.pipeline_name == name).orderBy("id", ascending=False).limit(1)
    row = newest.first()
    if row is None:
        raise LookupError(f"no pipeline named {name}")
    tasks = registry.task_rows(newest).orderBy("task_order").collect()
    addresses = [part.strip() for part in (row.notification_recipients or "").split(",") if part.strip()]
    return PipelineSpec(name, [TaskSpec(t.service, t.params) for t in tasks], addresses, row.cron_schedule or "")
