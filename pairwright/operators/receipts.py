"""Receipts of external results: what was asked, what came back, and whether a replay agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.evidence import digest

KEY = ("case_id", "variant", "evaluator")
HASHES = ("request", "response", "definition")


def receipts(results: DataFrame, request: Column, response: Column, definition: Column) -> DataFrame:
    """One receipt per external result (case_id, variant, evaluator, status): the result with hashes of its making."""
    made = zip(HASHES, (request, response, definition), strict=True)
    return results.select(*KEY, "status", *(digest(c).alias(f"{name}_hash") for name, c in made))


def repeated(found: DataFrame) -> DataFrame:
    """Keys with several receipts, of which there must be none."""
    return found.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def verified(wanted: DataFrame, stored: DataFrame, found: DataFrame) -> DataFrame:
    """Mismatches (case_id, variant, evaluator, mismatch) between what a run should hold and its receipts.

    ``wanted`` has the hashes as recomputed, ``stored`` the results as the run's cases tell them, both
    by the three keys.  A receipt that is missing, unused, hashed otherwise, or that tells another
    result each are rows; so is a receipt given again.
    """
    once = found.groupBy(*KEY).agg(F.count("*").alias("_n"), *(F.min(c).alias(f"_{c}") for c in ("status", *(f"{h}_hash" for h in HASHES))))
    rows = wanted.withColumn("_wanted", F.lit(True)).join(stored.select(*KEY, F.col("status").alias("_told")), list(KEY), "left").join(once, list(KEY), "full_outer")
    here = F.col("_wanted").isNotNull()
    faults = F.array_compact(F.array(
        F.when(here & F.col("_n").isNull(), F.lit("missing")), F.when(~here, F.lit("unused")), F.when(F.col("_n") > 1, F.lit("repeated")),
        *(F.when(here & ~F.col(f"_{h}_hash").eqNullSafe(F.col(f"{h}_hash")) & F.col("_n").isNotNull(), F.lit(f"{h}_hash")) for h in HASHES),
        F.when(here & F.col("_n").isNotNull() & ~F.col("_told").eqNullSafe(F.col("_status")), F.lit("result")),
    ))
    return rows.select(*KEY, F.explode(faults).alias("mismatch"))


def replay_report(stored: DataFrame, rows: DataFrame, receipts_wrong: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: evaluations replayed, mismatches of each sort, and whether the run is verified.

    ``rows`` come from ``review.replayed``, ``receipts_wrong`` from ``verified``, ``artifacts`` (relation, intact) from a manifest.
    """
    count = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
    parts = (count(stored, "replayed"), count(rows, "row_mismatches"), count(receipts_wrong, "receipt_mismatches"), count(artifacts.where("not intact"), "artifact_mismatches"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part, "_one")
    clean = (F.col("row_mismatches") == 0) & (F.col("receipt_mismatches") == 0) & (F.col("artifact_mismatches") == 0)
    return whole.withColumn("verified", clean).drop("_one")
