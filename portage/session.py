"""What the package needs to know about the caller's session; it never builds one itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from portage import storage

_local_root: str | None = None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``. Only a local session, where driver and executors are one machine, may go
    without that setting.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="portage-")
        root = f"file:{_local_root}"
    return storage.qualify(spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written to a new shared folder and read from there, so that what follows sees them as they are."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
