"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, as in tests, a new temporary folder in local mode and an error otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than reading the files again.

    Where the session's ``pairwright.run`` names a run, its folder holds all that is written until
    the setting changes, and may be removed once the run's results have been stored.
    """
    run = df.sparkSession.conf.get("pairwright.run", None)
    path = "/".join([shared_dir(df.sparkSession), *([run] if run else []), f"{name}-{uuid.uuid4().hex}"])
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released[T](made: T) -> T:
    """``made``, after the C library and Arrow's pool have given freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return made


def trimmed(batches: Iterator) -> Iterator:
    """The batches of a Python task; after each, freed memory goes back to the system.

    Workers live on from stage to stage, and what they have freed would else count as theirs.
    """
    for batch in batches:
        yield batch
        del batch
        released(None)


#: Rows that Spark hands a Python task at a time, at most: texts are long, and both sides hold whole batches.
BATCH_ROWS = 1000


def small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage, its first argument the session, that asks for batches of at most BATCH_ROWS rows.

    The option stays lowered in the session: frames are planned when they run, after this returns.
    It bounds memory alone; no result depends on it.
    """

    @functools.wraps(query)
    def with_small_batches(spark: SparkSession, *args) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(name, str(min(BATCH_ROWS, int(spark.conf.get(name)))))
        return query(spark, *args)

    return with_small_batches


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Fixed value: a run of the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of other characters; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
