"""The registry of pipelines: one row each, with its tasks as a JSON array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.functions import naming, params
from portage.operators.stores import FolderStore, TableStore
from portage.sources.tables import TableAccess

# Columns of the registry and the JSON shapes of its tasks.
SCHEMA = (
    "id bigint, pipeline_name string, notification_recipients string, cron_schedule string, services string"
)
TASKS = "array<struct<service: string, params: map<string, string>>>"
FORM_TASKS = "map<string, map<string, string>>"


class Registry:
    """Append-only registry in a folder or a table."""

    def __init__(self, spark: SparkSession, path: str = "", access: TableAccess | None = None, table: str = ""):
        self.spark = spark
        self.store = FolderStore(path, SCHEMA) if access is None else TableStore(access, table, SCHEMA)

    def append(self, pipelines: DataFrame) -> None:
        """Add pipelines (name, recipients, schedule, tasks as array or JSON); ids are unique and grow, with one writer at a
        time."""
        known = self.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        services = F.col("services")
        if pipelines.schema["services"].dataType.typeName() != "string":
            services = F.to_json(services)
        rows = pipelines.select(
            (F.monotonically_increasing_id() + F.lit(known) + 1).alias("id"),
            "pipeline_name",
            "notification_recipients",
            "cron_schedule",
            services.alias("services"),
        )
        self.store.append(rows)

    def read(self) -> DataFrame:
        return self.store.read(self.spark)


def task_rows(registry: DataFrame) -> DataFrame:
    """One row per task in its order: pipeline_name, task_order, service, params."""
    tasks = registry.select("pipeline_name", F.posexplode(F.from_json("services", TASKS)).alias("task_order", "task"))
    return tasks.select("pipeline_name", "task_order", "task.service", "task.params")


def form_task_rows(registry: DataFrame) -> DataFrame:
    """The same from form rows: a JSON map from service to parameters that end in ``_<task number>``."""
    entries = registry.select("pipeline_name", F.explode(F.from_json("services", FORM_TASKS)).alias("service", "form"))
    number = F.regexp_extract(_selection_key(F.col("form")), r"_(\d+)$", 1).cast("int")
    numbered = entries.where(number.isNotNull()).select("pipeline_name", "service", "form", number.alias("number"))
    return numbered.select(
        "pipeline_name",
        (F.col("number") - 1).alias("task_order"),
        "service",
        params.without_suffix(F.col("form"), F.col("number")).alias("params"),
    )


def _selection_key(form: Column) -> Column:
    return F.get(F.filter(F.map_keys(form), lambda key: F.startswith(key, F.lit("select_service_"))), F.lit(0))


def recipient_rows(registry: DataFrame) -> DataFrame:
    """One row per pipeline and recipient."""
    recipients = naming.split_list(F.col("notification_recipients"))
    return registry.select("pipeline_name", F.explode(recipients).alias("recipient"))
