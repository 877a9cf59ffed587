"""Where intermediate tables go: the shared folder named by the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or, where that is unset, in ``gridcast.scratch.dir``."""
    for name in ("spark.checkpoint.dir", "gridcast.scratch.dir"):
        if configured := spark.conf.get(name, None):
            return configured
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several later jobs read, so that none recomputes it.

    A Parquet table in the shared folder: it survives lost executors, later jobs
    read only the columns they need, and its size is known to the planner.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written by this session."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
