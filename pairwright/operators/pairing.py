"""Joining cases to the outputs of both variants, so that every known case stays in the denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSITIONS = ("both_pass", "baseline_only_pass", "candidate_only_pass", "both_fail")


def with_outputs(cases: DataFrame, outputs: DataFrame, id_col: str = "id") -> DataFrame:
    """Every case once, with its output, or with status ``missing``; of columns of both, the case's stay."""
    outputs = outputs.drop(*(set(outputs.columns) & set(cases.columns)))
    return or_missing(cases.join(outputs, cases[id_col] == outputs["case_id"], "left").drop("case_id"))


def or_missing(rows: DataFrame) -> DataFrame:
    """Rows without an output say so."""
    lost = F.col("status").isNull()
    return rows.withColumn("error_kind", F.when(lost, F.lit("missing_output")).otherwise(F.col("error_kind"))).withColumn("status", F.coalesce("status", F.lit("missing")))


def unknown_outputs(cases: DataFrame, outputs: DataFrame, id_col: str = "id") -> DataFrame:
    """Outputs of no known case; there must be none."""
    return outputs.join(cases, outputs["case_id"] == cases[id_col], "left_anti")


def label_blind(cases: DataFrame, id_col: str = "id") -> DataFrame:
    """What an evaluated system may see of cases: their input and visible metadata, and no other column."""
    return cases.select(id_col, *(c for c in ("input", "model_visible_metadata") if c in cases.columns))


def coverage(ids: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: ids that both have, that either lacks, and ids given twice."""
    seen = lambda df, name: df.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias(name))
    whole = ids.select("id").distinct().join(seen(baseline, "b"), "id", "left").join(seen(candidate, "c"), "id", "left")
    return whole.agg(
        F.count_if(F.col("b").isNotNull() & F.col("c").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("missing_baseline"), F.count_if(F.col("c").isNull()).alias("missing_candidate"),
        F.count_if(F.col("b") > 1).alias("repeated_baseline"), F.count_if(F.col("c") > 1).alias("repeated_candidate"),
    )


def transition(baseline: Column, candidate: Column) -> Column:
    """The cell of a pair of verdicts; unknown verdicts are failures."""
    b, c = F.coalesce(baseline, F.lit(False)), F.coalesce(candidate, F.lit(False))
    return F.when(b & c, TRANSITIONS[0]).when(b, TRANSITIONS[1]).when(c, TRANSITIONS[2]).otherwise(TRANSITIONS[3])


def paired(evaluations: DataFrame, key: str = "case_id") -> DataFrame:
    """Baseline and candidate evaluations of a case side by side, as structs; one shuffle, no join.

    Each column is its own aggregate, so only those that are used later are computed and
    shuffled.  A case has one row per variant; of repeated rows no whole one would be kept.
    """
    columns = [c for c in evaluations.columns if c not in (key, "variant")]
    sides = ("baseline", "candidate")
    found = evaluations.groupBy(key).agg(*(F.max(F.when(F.col("variant") == s, F.col(f"`{c}`"))).alias(f"{s}.{c}") for s in sides for c in columns))
    return found.select(key, *(F.struct(*(F.col(f"`{s}.{c}`").alias(c) for c in columns)).alias(s) for s in sides))


def execution_token(nonce: str, ordinal: Column) -> Column:
    """A name for a case that tells nothing of its id."""
    return F.concat(F.lit("case-"), F.substring(F.sha2(F.concat_ws("\0", F.lit(nonce), ordinal.cast("string")).cast("binary"), 256), 1, 24))


def remapped(rows: DataFrame, cases: DataFrame, nonce: str, ordinal: Column, id_col: str = "id") -> DataFrame:
    """Rows named by token (``case_id``) under their cases' own ids again; rows of no known token drop out."""
    names = cases.select(F.col(id_col).alias("_id"), execution_token(nonce, ordinal).alias("_token"))
    return rows.join(names, rows["case_id"] == names["_token"]).withColumn("case_id", F.col("_id")).drop("_id", "_token")
