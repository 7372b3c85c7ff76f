"""Saved cases: a table that writers change by revision, refreshed by runs, and what it takes to accept a new baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.review import pin_status, suite_summary
from pairwright.sources import snapshots

PIN = "case_id string, run_id string, note string, origin_passed boolean, suite_status string, last_run_id string"
_NAME = "pins"


def saved(spark: SparkSession, base: str) -> tuple[DataFrame, snapshots.Snapshot]:
    """The saved cases, and the revision that a change of them is made from."""
    found = snapshots.current(spark, base, _NAME)
    return (snapshots.read(spark, found, _NAME) if found.revision else spark.createDataFrame([], PIN)), found


def save(spark: SparkSession, base: str, cases: DataFrame, after: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    """Add cases (case_id, run_id, note, origin_passed), or change those that are saved: the note only, for where a case stood when it was first saved stays.

    Raises Conflict if the saved cases have changed since ``after``.
    """
    before, found = saved(spark, base)
    new = cases.groupBy("case_id").agg(*(F.min(c).alias(c) for c in ("run_id", "note", "origin_passed")))
    n, b = new.alias("n"), before.alias("b")
    whole = b.join(n, F.col("b.case_id") == F.col("n.case_id"), "full_outer").select(
        F.coalesce("b.case_id", "n.case_id").alias("case_id"), F.coalesce("b.run_id", "n.run_id").alias("run_id"), F.coalesce("n.note", "b.note").alias("note"),
        F.coalesce("b.origin_passed", "n.origin_passed").alias("origin_passed"), F.col("b.suite_status").alias("suite_status"), F.col("b.last_run_id").alias("last_run_id"),
    )
    return snapshots.commit(spark, base, _NAME, {_NAME: whole}, after=after or found)


def drop(spark: SparkSession, base: str, case_ids: DataFrame, after: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    before, found = saved(spark, base)
    return snapshots.commit(spark, base, _NAME, {_NAME: before.join(case_ids.select("case_id"), "case_id", "left_anti").select(*before.columns)}, after=after or found)


def refresh(spark: SparkSession, base: str, run_id: str, verdicts: DataFrame, after: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    """Give each saved case its status in a run (``verdicts``: case_id, passes), from the status that is stored; one that the run lacks is missing."""
    before, found = saved(spark, base)
    seen = verdicts.groupBy(F.col("case_id").alias("_id")).agg(F.min("passes").alias("_passes"))
    rows = before.join(seen, F.col("case_id") == F.col("_id"), "left")
    status = pin_status(F.col("_passes"), F.col("origin_passed"), F.col("suite_status"))
    rows = rows.withColumns({"suite_status": status, "last_run_id": F.lit(run_id)}).select(*before.columns)
    return snapshots.commit(spark, base, _NAME, {_NAME: rows}, after=after or found)


def blocking(spark: SparkSession, base: str) -> bool:
    """Whether a saved case is missing or wrong again, or hasn't been looked at in any run."""
    before, _ = saved(spark, base)
    row = suite_summary(before).first()
    return bool(row.blocking) or before.where("suite_status IS NULL").limit(1).count() > 0


def accept_baseline(spark: SparkSession, base: str, run_id: str, decided: DataFrame, after: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    """Make a run the baseline: its stored decision has to be verified and to authorise a deployment, and no saved case may block.

    ``decided`` comes from ``store.stored_decision`` of that run.
    """
    row = decided.first()
    stands = {"verified": row.integrity == "verified", "authorized": bool(row.deployment_authorized), "no blocking saved case": not blocking(spark, base)}
    if missing := [what for what, met in stands.items() if not met]:
        raise PermissionError(f"{run_id} can't become the baseline: it lacks {missing}")
    return snapshots.commit(spark, base, "baseline", {}, info={"run_id": run_id}, after=after or snapshots.current(spark, base, "baseline"))


def baseline(spark: SparkSession, base: str) -> str | None:
    """The run that was accepted last."""
    return snapshots.current(spark, base, "baseline").info.get("run_id")
