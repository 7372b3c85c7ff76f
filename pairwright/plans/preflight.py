"""Checks of cases before any output is read: references, isolation of gold values, evidence that may collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.json import json_string, scalars
from pairwright.functions.subtrees import held, subtrees
from pairwright.operators import evidence, review
from pairwright.plans.paired import Evaluation, reference_issues


def leaks(cases: DataFrame) -> DataFrame:
    """Cases with what their gold values give away: a scalar of the reference that stands anywhere in what the evaluated system sees, or in the id.

    Scalars are equal as JSON, nulls aside; each case is compared with itself alone, so nothing is joined.
    """
    gold = scalars(F.col("expected"))
    seen = F.concat(*(F.coalesce(scalars(F.col(c)), F.array().cast("array<string>")) for c in ("input", "model_visible_metadata") if c in cases.columns))
    named = F.exists("_gold", lambda x: F.coalesce(review.suspicious_id(F.col("id"), json_string(x)), F.lit(False)))
    rows = cases.withColumns({"_gold": gold, "_seen": seen})
    rows = rows.withColumns({"gold_visible": F.coalesce(F.arrays_overlap("_gold", "_seen"), F.lit(False)), "id_suspicious": F.coalesce(named, F.lit(False))})
    return rows.drop("_gold", "_seen")


def held_values(cases: DataFrame) -> DataFrame:
    """Cases with ``held``: pointers of the reference's values, objects and arrays too, that stand anywhere in what the evaluated system sees."""
    seen = F.concat(*(subtrees(F.col(c)) for c in ("input", "model_visible_metadata") if c in cases.columns))
    rows = cases.withColumns({"_gold": subtrees(F.col("expected")), "_seen": seen})
    return rows.withColumn("held", held(F.col("_gold"), F.col("_seen"))).drop("_gold", "_seen")


def doctor(cases: DataFrame, plan: Evaluation, *, strict: bool = False, pointer: str | None = None, include: tuple[str, ...] = evidence.INCLUDE) -> DataFrame:
    """One row per check: whether it passed, whether it has to, and how many cases stand against it.

    Colliding evidence is told, never a failure: only outputs show whether rows are copies or trials.
    """
    found, lost = evidence.with_units(cases, pointer, include)
    conflicts = evidence.label_conflicts(cases, evidence.digest(*(F.col(c) for c in ("input", "model_visible_metadata") if c in cases.columns)), F.col("expected"))
    seen = leaks(cases)
    count = lambda df: df.agg(F.count("*").alias("cases"))
    checks = (
        ("reference_preflight", True, False, count(reference_issues(cases, plan))), ("label_conflicts", True, False, count(conflicts)), ("evidence_unit_resolves", True, False, count(lost)),
        ("golden_value_isolation", strict, False, count(seen.where("gold_visible"))), ("suspicious_ids", False, False, count(seen.where("id_suspicious"))),
        ("potential_evidence_collisions", False, True, evidence.collisions(found, F.col("unit")).select(F.col("colliding_rows").alias("cases"))),
    )
    out = None
    for name, required, always, n in checks:
        row = n.select(F.lit(name).alias("check"), (F.lit(always) | (F.col("cases") == 0)).alias("passed"), F.lit(required).alias("required"), F.col("cases").cast("long").alias("cases"))
        out = row if out is None else out.union(row)
    return out
