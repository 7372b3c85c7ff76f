"""An extension: outputs that arrive as files are scored by the batch plan, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pairwright.plans.paired import Evaluation, evaluate


def read_outputs(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int = 100) -> DataFrame:
    """Recorded outputs as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(outputs: DataFrame, cases: DataFrame, variant: str, plan: Evaluation, target: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's evaluations, once however often the batch is tried: a batch owns its folder.

    Only cases with an output in the batch are scored; the batch plan over all of them tells what is missing.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = cases.join(batch.select(F.col("case_id").alias("id")).distinct(), "id", "left_semi")
        evaluate(known, batch, variant, plan).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return outputs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_health(outputs: DataFrame, time: str, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of states by event-time window; rows later than the watermark allows are dropped by Spark."""
    return outputs.withWatermark(time, late).groupBy(F.window(time, width), "status").agg(F.count("*").alias("n"))
