"""An index of cases by runs of three characters, so that a search reads texts only where they may match.

A posting holds a run of three characters, a block of cases, and which of the block's cases have
it.  Postings lie in folders by a hash of the run, in its order, so a search reads the files of its
own runs and Parquet skips what lies beside them.  Blocks bound a posting's length, however common
its run is.  A search intersects the lists of each block, the shortest first, and then reads the
texts of the cases that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cases in a block, folders of postings, and how many of a query's lists are intersected.
BLOCK, BUCKETS, LISTS = 1 << 14, 64, 6
#: Places that a task gathers before it gives its lists.
HELD = 1_000_000
#: Stands after a text's end, so that its last two characters begin runs too.
_END = "\0\0"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _runs(whole: str) -> set[str]:
    return {whole[i : i + 3] for i in range(len(whole) - 2)}


def _postings(texts: DataFrame) -> DataFrame:
    """Lists of places by run and block, as much of them as a task holds at once; texts lie in order of their blocks.

    Runs are found in one pass over a text, as Spark's own substrings count from a text's start each
    time, and gathered in the task, which never holds the runs of many texts beside each other.
    """
    kind = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("places", pa.list_(pa.int32()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        block, n = None, 0
        given = lambda: pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([block] * len(held), pa.int64()), pa.array(held.values(), kind.field("places").type)], schema=kind)
        for batch in batches:
            for i in range(batch.num_rows):
                at, place, text = (batch.column(c)[i].as_py() for c in range(3))
                if held and (at != block or n > HELD):
                    yield given()
                    held, n = {}, 0
                block, found = at, _runs(text + _END)
                n += len(found)
                for gram in found:
                    places = held.get(gram)
                    if places is None:
                        held[gram] = [place]
                    else:
                        places.append(place)
        if held:
            yield given()

    return texts.select("block", "place", "text").mapInArrow(gather, "gram string, block long, places array<int>")


def build(cases: DataFrame, path: str, *, id_col: str = "case_id", number: str = "ordinal", text_col: str = "search_text") -> None:
    """Write the index of cases under ``path``: texts, in lower case, and postings.

    ``number`` is a whole number of its own for each case, best without gaps.  A null text is empty,
    and found by no query but the empty one.
    """
    at = F.col(number).cast("long")
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = cases.select(F.floor(at / BLOCK).cast("long").alias("block"), F.pmod(at, F.lit(BLOCK)).cast("int").alias("place"), F.col(id_col).alias("case_id"), low.alias("text"))
    texts.repartitionByRange("block", "place").sortWithinPartitions("block", "place").write.parquet(f"{path}/texts")
    spark = cases.sparkSession
    kept = spark.read.parquet(f"{path}/texts")
    lists = _postings(kept.where("text <> ''")).groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))  # BLOCK places at most
    lists = lists.withColumns({"n": F.size("places"), "bucket": _bucket(F.col("gram"))})
    lists.repartition("bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Cases (block, place) that have all of the query's runs of three characters; of a shorter query, those that hold it."""
    postings = spark.read.parquet(f"{path}/postings")
    if len(query) < 3:
        held = postings.where(F.col("gram").startswith(query))
        return held.select("block", F.explode("places").alias("place")).distinct()
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct()
    buckets = [r.b for r in wanted.collect()]  # numbers below BUCKETS
    lists = postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    by = lists.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "places"))).alias("lists")).where(F.size("lists") == len(grams))
    shortest = F.slice(F.transform("lists", lambda x: x["places"]), 1, LISTS)
    both = F.aggregate(F.slice(shortest, 2, LISTS), F.get(shortest, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return by.select("block", F.explode(both).alias("place"))


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Cases whose text holds the query, letter case aside: case_id, block and place.  Its characters stand for themselves; an empty query finds all."""
    if len(query) > 256:
        raise ValueError("a query has at most 256 characters")
    texts = spark.read.parquet(f"{path}/texts")
    if not query:
        return texts.select("case_id", "block", "place")
    low = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first().q
    found = texts.join(candidates(spark, path, low), ["block", "place"])
    return found.where(F.contains("text", F.lit(low))).select("case_id", "block", "place")
