"""Tables and files between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a new temporary folder in local mode, and an error otherwise.

    Where the session's ``pairwright.run`` names a run, the path lies in its folder, which may be
    removed once the run's results have been stored.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    run = spark.conf.get("pairwright.run", None)
    return "/".join([base.rstrip("/"), *([run] if run else []), f"{name}-{uuid.uuid4().hex}"])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as written and read again: what made them isn't run again, and a lost executor costs no more than reading."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
