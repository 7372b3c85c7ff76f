"""Ids of any type as whole numbers in the same order, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pairwright.llm.mixing import numbered
from pairwright.llm.scratch import written


def ordered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows with ``id_col`` as long, and the table that names the numbers.

    Whole numbers stay what they are and need no table.  Ids of any other type that Spark can
    sort, texts above all, are numbered by their order; only counts of ranges come to the driver.
    """
    if isinstance(df.schema[id_col].dataType, IntegralType):
        return df.withColumn(id_col, F.col(id_col).cast("long")), None
    names = written(numbered(df.select(F.col(id_col).alias("named")).where("named IS NOT NULL").distinct(), "named"), "names").withColumnRenamed("place", "numbered")
    columns = [F.col("numbered").alias(id_col) if c == id_col else F.col(c) for c in df.columns]
    return df.join(names, df[id_col] == names["named"], "left").select(*columns), names


def restored(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """The rows with numbers in ``columns`` replaced by what they stand for."""
    if names is None:
        return df
    for c in columns:
        df = df.join(names.select(F.col("numbered").alias("_number"), F.col("named").alias("_name")), F.col(c) == F.col("_number"), "left").withColumn(c, F.col("_name")).drop("_number", "_name")
    return df
