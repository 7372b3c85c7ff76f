"""Evaluations that are scored once: what a case, an output and a plan come to is stored under a hash of all three."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.evidence import digest
from pairwright.plans.paired import Evaluation, _joined, _scored, read_references

#: Bound to a stored evaluation's key, and raised whenever a plan would come to something else on the same texts.
EDITION = 1


def fingerprint(plan: Evaluation) -> str:
    """A hash of all that a plan says; options in any order give the same."""
    return hashlib.sha256(json.dumps([EDITION, asdict(plan)], sort_keys=True, default=str).encode()).hexdigest()


def content(plan: Evaluation):
    """The key of a row: its plan, reference, status and output.  Ids, variants and measures are no part of it."""
    return digest(F.lit(fingerprint(plan)), F.col("expected"), F.col("status"), F.when(F.col("status") == "ok", F.col("raw_output")))


def evaluate_again(cases: DataFrame, outputs: dict[str, DataFrame], plan: Evaluation, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Evaluations as ``evaluate_all`` gives them, with whether each is ``reused``; and what is to be stored in addition.

    ``stored`` is what earlier runs returned to store, from any plan.  Only rows whose key isn't
    there are parsed and scored, and of equal ones one each is stored: an interrupted run that
    stored its first parts goes on from there.  External evaluators keep receipts of their own, so
    plans with them are refused.
    """
    if any(r.kind == "external" for r in plan.rules):
        raise ValueError("results of external evaluators aren't kept by content")
    rows = _joined(cases, outputs).withColumn("content", content(plan))
    names = [c for c in rows.columns if c not in ("id", "content")]
    if stored is None:
        fresh, kept = rows, None
    else:
        known = stored.where(F.col("plan") == fingerprint(plan)).drop("plan").dropDuplicates(["content"])
        fresh = rows.join(known.select("content"), "content", "left_anti")
        kept = rows.withColumnRenamed("id", "case_id").join(known, "content")
    # A key's rows are scored once; cases that share it are joined to the result.
    once = fresh.select("content", "expected", "status", "raw_output").dropDuplicates(["content"]).withColumn("id", F.col("content"))
    scored = _scored(read_references(once, plan), plan)
    results = [c for c in scored.columns if c not in ("case_id", "content", "expected", "status", "raw_output", "error_kind")]
    made = scored.select("content", *results)
    new = fresh.withColumnRenamed("id", "case_id").join(made, "content").withColumn("reused", F.lit(False))
    columns = ["case_id", *names, *results, "reused"]
    whole = new.select(*columns) if kept is None else new.select(*columns).unionByName(kept.withColumn("reused", F.lit(True)).select(*columns))
    return whole, made.select(F.lit(fingerprint(plan)).alias("plan"), "content", *results)
