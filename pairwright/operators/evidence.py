"""Independent units of evidence: rows with one stimulus are one unit, repeats are found out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.json import read_json

#: Parts of a case, as JSON texts, and those that make its stimulus unless told: metadata is no part of it.
PARTS = ("input", "expected", "model_visible_metadata", "metadata")
INCLUDE = ("/input", "/expected", "/model_visible_metadata")


def digest(*columns: Column) -> Column:
    """One hash of several values; null and text apart, and each value's length before it, so that no two lists of values read alike."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(*columns: Column) -> Column:
    """As ``digest``, in half as many bytes: for rows that travel."""
    return F.unhex(digest(*columns))


def unit_label(pointer: str | None = None, include: tuple[str, ...] = INCLUDE) -> str:
    """What a report says of how units are told apart."""
    return f"pointer:{pointer}" if pointer is not None else f"fingerprint:{','.join(include)}"


def with_units(cases: DataFrame, pointer: str | None = None, include: tuple[str, ...] = INCLUDE) -> tuple[DataFrame, DataFrame]:
    """Cases with the key of their unit of evidence, and those that have none.

    A unit is the value at a pointer into the case, or else the values at all of ``include``.  A part
    that a case lacks is null, which is a value; a pointer that leads nowhere in a case is an error,
    so such cases come back apart (id, pointer).
    """
    if pointer is not None and tuple(include) != INCLUDE:
        raise ValueError("a unit is named by a pointer or by an include list, not by both")
    wanted = [pointer] if pointer is not None else list(dict.fromkeys(include))
    if not wanted or any(not p.startswith("/") for p in wanted):
        raise ValueError(f"no such pointers: {wanted}")
    text = lambda c: F.coalesce(F.col(c), F.lit("null")) if c in cases.columns else F.lit("null")
    whole = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), text(c)) for c in PARTS)), F.lit("}"))
    read = cases.withColumn("_found", read_json(whole, wanted, once=True)["found"])
    lost = F.get(F.filter(F.arrays_zip(F.array(*map(F.lit, wanted)).alias("pointer"), F.col("_found").alias("value")), lambda x: x["value"].isNull()), F.lit(0))["pointer"]
    read = read.withColumn("_lost", F.when(F.col("_found").isNull(), F.lit(wanted[0])).otherwise(lost))
    known = read.where("_lost is null").withColumn("unit", digest(*(F.get("_found", F.lit(i)) for i in range(len(wanted)))))
    return known.drop("_found", "_lost"), read.where("_lost is not null").select("id", F.col("_lost").alias("pointer"))


def _kind() -> Column:
    return F.when(F.col("rows") == 1, "singleton").when(F.col("distinct_observations") == 1, "exact_duplicate").otherwise("repeated_trial")


def units(rows: DataFrame, stimulus: Column, observation: Column) -> DataFrame:
    """One row per unit: rows, distinct observations and kind.

    Alone a unit is a singleton; rows that observe the same are exact duplicates; rows that
    don't are repeated trials, of which none may stand for the others.  Distinct observations
    are counted as rows of (unit, observation), so no unit's rows meet in one task.
    """
    seen = rows.select(stimulus.alias("unit"), observation.alias("observation")).groupBy("unit", "observation").agg(F.count("*").alias("n"))
    return seen.groupBy("unit").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_observations")).withColumn("kind", _kind())


def independent(rows: DataFrame, stimulus: Column, observation: Column, order: str) -> DataFrame:
    """Singletons, and of exact duplicates the first row by ``order``; repeated trials drop out."""
    named = rows.withColumn("_unit", stimulus).withColumn("_seen", observation)
    first = named.groupBy("_unit", "_seen").agg(F.min(order).alias("_first"))
    kinds = first.groupBy("_unit").agg(F.count("*").alias("_kinds"), F.min("_first").alias("_first"))
    keep = kinds.where("_kinds = 1").select("_unit", "_first")
    return named.join(keep.withColumnRenamed("_unit", "_u"), (F.col("_unit") == F.col("_u")) & (F.col(order) == F.col("_first"))).drop("_unit", "_seen", "_u", "_first")


def represented(rows: DataFrame, unit: Column, observation: Column, order: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """As ``units``, with each unit's first row by ``order`` as the struct ``row``; rows of one unit need different orders.

    Rows travel through both aggregates, of them all columns or those named: callers name the few that they judge by.
    """
    named = rows.select(unit.alias("unit"), observation.alias("observation"), F.col(order).alias("_order"), F.struct(*(rows.columns if columns is None else columns)).alias("row"))
    first = [F.min_by("row", "_order").alias("row"), F.min("_order").alias("_order")]
    seen = named.groupBy("unit", "observation").agg(F.count("*").alias("n"), *first)
    return seen.groupBy("unit").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_observations"), *first).drop("_order").withColumn("kind", _kind())


def unit_counts() -> list[Column]:
    """Aggregates over units: by kind, duplicate rows and their share, the largest unit, and units that count."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    rows = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rows")).otherwise(0))
    return [
        F.sum("rows").alias("total_rows"), F.count("*").alias("units"), n("singleton").alias("singletons"), n("exact_duplicate").alias("duplicate_groups"), n("repeated_trial").alias("repeated_trial_groups"),
        (rows("exact_duplicate") - n("exact_duplicate")).alias("exact_duplicate_rows"), F.max("rows").alias("largest_group"), (n("singleton") + n("exact_duplicate")).alias("effective_units"),
        F.round(F.coalesce(F.try_divide(rows("exact_duplicate") - n("exact_duplicate"), F.sum("rows")), F.lit(0.0)), 9).alias("duplicate_row_rate"),
    ]


def unit_summary(found: DataFrame) -> DataFrame:
    """One row: the counts of units."""
    return found.agg(*unit_counts())


def label_conflicts(rows: DataFrame, stimulus: Column, reference: Column) -> DataFrame:
    """Stimuli with several references: an error of the data set."""
    pairs = rows.select(stimulus.alias("unit"), reference.alias("reference")).groupBy("unit", "reference").agg(F.count("*").alias("n"))
    return pairs.groupBy("unit").agg(F.count("*").alias("references"), F.sum("n").alias("rows")).where("references > 1")


def conflicting_lines(rows: DataFrame, stimulus: Column, reference: Column, line: Column) -> DataFrame:
    """Of stimuli with several references, the first line of the stimulus and the first of each other reference: what an error tells."""
    seen = rows.select(stimulus.alias("unit"), reference.alias("reference"), line.alias("line")).groupBy("unit", "reference").agg(F.min("line").alias("line"))
    first = seen.groupBy(F.col("unit").alias("_unit")).agg(F.min("line").alias("first_line"))
    return seen.join(first, F.col("unit").eqNullSafe(F.col("_unit"))).where(F.col("line") > F.col("first_line")).select("unit", "first_line", "line")


def collisions(rows: DataFrame, stimulus: Column) -> DataFrame:
    """One row: rows, distinct stimuli, and rows beyond the first of each."""
    by = rows.select(stimulus.alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_stimuli"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("colliding_rows"))
