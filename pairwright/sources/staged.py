"""Files that are known by what they hold: digests of their parts, put together to one of each file and one of all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a part.
PART = 1 << 20


def parts(spark: SparkSession, path: str, *, size: int = PART) -> DataFrame:
    """Digest of every part of every file under a path: file (its path below ``path``), part, bytes and digest.

    A file of no bytes holds nothing, and isn't listed.  A task reads a file whole, of 2 GB at most.
    """

    def digested(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                cut = [data[at : at + size] for at in range(0, len(data), size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array([len(c) for c in cut], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in cut])], names=["file", "part", "bytes", "digest"]
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/")
    below = F.element_at(F.split(F.col("path"), root, 2), -1)
    return files.select(below.alias("file"), "content").mapInArrow(digested, "file string, part int, bytes long, digest string")


def files(found: DataFrame) -> DataFrame:
    """One row per file: parts, bytes and the digest of its parts' digests in order."""
    of = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda p: p["digest"]), "").cast("binary"), 256)
    return found.groupBy("file").agg(F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), of.alias("digest"))


def address(found: DataFrame) -> str:
    """What a whole source is known by: a digest over its files' sorted names and digests, of which digests by ranges of the names' hash come to the driver."""
    named = files(found).select(F.sha2(F.concat_ws("\0", "file", "digest").cast("binary"), 256).alias("d"))
    by = named.groupBy(F.substring("d", 1, 2).alias("range")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "").cast("binary"), 256).alias("d"))
    return hashlib.sha256("".join(r.range + r.d for r in by.orderBy("range").collect()).encode()).hexdigest()


def faults(spark: SparkSession, path: str, known: DataFrame, *, size: int = PART) -> DataFrame:
    """Parts that aren't what was staged: file, part and fault (changed, lost or new); none let a source be loaded."""
    now = parts(spark, path, size=size).select(F.col("file").alias("_file"), F.col("part").alias("_part"), F.col("digest").alias("_now"))
    both = known.join(now, (known["file"] == F.col("_file")) & (known["part"] == F.col("_part")), "full_outer")
    fault = F.when(F.col("_now").isNull(), "lost").when(F.col("digest").isNull(), "new").when(F.col("digest") != F.col("_now"), "changed")
    return both.select(F.coalesce("file", "_file").alias("file"), F.coalesce("part", "_part").alias("part"), fault.alias("fault")).where("fault IS NOT NULL")


def verified(spark: SparkSession, path: str, known: DataFrame, *, size: int = PART) -> str:
    """The path again, if its files hold what was staged; else an error that names the first 20 parts that don't."""
    if wrong := faults(spark, path, known, size=size).orderBy("file", "part").limit(20).collect():
        raise ValueError(f"{path} is not what was staged: {[tuple(r) for r in wrong]}")
    return path
