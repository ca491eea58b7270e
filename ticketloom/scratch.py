"""Tables in the folder that driver and executors share: lineage is cut there, and loads keep what they have stored."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ON_ONE_MACHINE: dict[str, str] = {}


def shared_path(spark: SparkSession) -> str:
    """A fresh path under the session's ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (tests) a temporary folder takes its place; a
    cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _ON_ONE_MACHINE.get(app) or _ON_ONE_MACHINE.setdefault(app, "file://" + tempfile.mkdtemp(prefix="ticketloom-"))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over ``spark.sql.shuffle.partitions`` tasks, for work that takes long for each row.

    Without it the rows of a small file, or of a large one that was written as a single group of rows, are all
    worked through by the task that reads them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table, at a fresh shared path if none is given."""
    path = path or shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
