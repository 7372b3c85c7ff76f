"""Outcomes of several evaluators, and what follows for a case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.operators.evaluators import ERROR, FAILED, NOT_APPLICABLE, PASSED

TRUE, FALSE = "true", "false"


def all_of(statuses: Column) -> Column:
    """False if any failed, else an error if any is one or has no status, else not applicable if any is; else true.

    An evaluator without a status comes before all else.
    """
    has = lambda s: F.array_contains(statuses, s)
    return F.when(F.exists(statuses, lambda s: s.isNull()), ERROR).when(has(FAILED), FALSE).when(has(ERROR), ERROR).when(has(NOT_APPLICABLE), NOT_APPLICABLE).otherwise(TRUE)


def any_of(statuses: Column) -> Column:
    """True if any passed, else an error if any is one, not applicable if all are; else false."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(F.exists(statuses, lambda s: s.isNull()), ERROR).when(has(PASSED), TRUE).when(has(ERROR), ERROR).when(F.forall(statuses, lambda s: s == NOT_APPLICABLE), NOT_APPLICABLE).otherwise(FALSE)


def fully_evaluated(statuses: Column) -> Column:
    """No component is an error, not applicable or without a status."""
    return F.forall(statuses, lambda s: F.coalesce(s.isin(PASSED, FAILED), F.lit(False)))


def case_flags(status: Column, schema_valid: Column, truth: Column, full: Column) -> dict[str, Column]:
    """What a case's evaluation amounts to."""
    structured, passes = (status == "ok") & schema_valid, truth == TRUE
    wrong = schema_valid & (truth == FALSE)
    return {
        "structured_success": structured, "semantic_success": passes, "deployment_success": structured & passes & full,
        "valid_but_wrong": wrong, "fully_evaluated_valid_but_wrong": wrong & full,
    }


def display(truth: Column, full: Column) -> Column:
    """An outcome in a reader's words; an outcome that isn't there is unscored."""
    return (
        F.when(truth.isNull() | (truth == "unscored"), "Unscored").when((truth == TRUE) & full, "Correct").when((truth == FALSE) & full, "Wrong")
        .when(truth == ERROR, "Evaluation error").when(truth == NOT_APPLICABLE, "N/A").otherwise("Incomplete")
    )


def transition_display(transition: Column) -> Column:
    return F.when(transition == "baseline_only_pass", "Regression").when(transition == "candidate_only_pass", "Improvement").when(transition == "both_pass", "Both pass").otherwise("Both fail")
