"""Aggregates of evaluations: per variant, per evaluator, per field, matched over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.stats import mcnemar, nearest_rank, paired_counts
from pairwright.operators.outcomes import FALSE, TRUE


def rate(n: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n, total), F.lit(0.0)), 9)


def variant_summary(e: DataFrame) -> DataFrame:
    """Counters per variant: states, validity, verdicts, and the outcome's components.

    A row without an outcome adds one required component, which is unscored.
    """
    flag = lambda name: F.count_if(F.col(name))
    part = lambda s: F.sum(F.size(F.filter("components", lambda x: x == s)))
    return e.groupBy("variant").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("error_kind") == "timeout").alias("timeouts"), flag("parse_valid").alias("parse_valid"), flag("schema_valid").alias("schema_valid"), flag("structured_success").alias("structured_success"),
        flag("semantic_success").alias("semantic_success"), flag("deployment_success").alias("deployment_success"), flag("valid_but_wrong").alias("valid_but_wrong"), flag("fully_evaluated").alias("fully_evaluated"),
        F.sum(F.greatest(F.size("components"), F.lit(1))).alias("required_components"), part("error").alias("error_components"), part("not_applicable").alias("not_applicable_components"),
        F.sum(F.size(F.filter("components", lambda x: x.isNull())) + F.when(F.size("components") == 0, 1).otherwise(0)).alias("unscored_components"),
    )


def operational_summary(e: DataFrame) -> DataFrame:
    """Latency, retries and tokens per variant; the median and the 95th percentile round their place up."""
    ranks = nearest_rank(e, ["variant"], "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95})
    totals = e.groupBy("variant").agg(
        F.count("latency_ms").alias("latency_rows"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("retries"),
        F.count("input_tokens").alias("usage_rows"), F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
    )
    return totals.join(ranks, "variant", "left")


def cost_summary(e: DataFrame) -> DataFrame:
    """Exact cost per variant, only where there is a single currency."""
    by = e.where("cost is not null").groupBy("variant", "currency").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    one = F.count("*") == 1
    return by.groupBy("variant").agg(
        F.count("*").alias("currencies"), (F.count("*") > 1).alias("mixed_currencies"), F.sum("n").alias("cost_rows"), F.when(one, F.max("currency")).alias("currency"),
        F.when(one, F.round(F.sum("cost").cast("double"), 6)).alias("total_cost"), F.when(one, F.round(F.sum("cost").cast("double") / F.sum("n"), 9)).alias("average_cost"),
    )


def matched_operational(pairs: DataFrame) -> DataFrame:
    """One row over pairs that both measured: p95 latencies, and average costs if all pairs have one currency."""
    b, c = (lambda n: F.col(f"baseline.{n}")), (lambda n: F.col(f"candidate.{n}"))
    timed = pairs.where(b("latency_ms").isNotNull() & c("latency_ms").isNotNull())
    long = timed.select(F.explode(F.array(F.struct(F.lit("b").alias("side"), b("latency_ms").alias("ms")), F.struct(F.lit("c").alias("side"), c("latency_ms").alias("ms")))).alias("x")).select("x.*")
    p95 = nearest_rank(long, ["side"], "ms", {"p95": 0.95})
    lat = p95.agg(F.max(F.when(F.col("side") == "b", F.col("p95"))).alias("baseline_p95_ms"), F.max(F.when(F.col("side") == "c", F.col("p95"))).alias("candidate_p95_ms"))
    paid = pairs.where(b("cost").isNotNull() & c("cost").isNotNull() & (b("currency") == c("currency")))
    cost = paid.agg(
        F.count("*").alias("cost_pairs"), (F.count("*") > 0).alias("any"), (F.min(b("currency")) == F.max(b("currency"))).alias("one"),
        F.round(F.sum(b("cost")).cast("double") / F.count("*"), 9).alias("baseline_cost"), F.round(F.sum(c("cost")).cast("double") / F.count("*"), 9).alias("candidate_cost"),
    )
    n = timed.agg(F.count("*").alias("latency_pairs"))
    one_row = lambda df: df.withColumn("_one", F.lit(1))
    out = one_row(n).join(one_row(lat), "_one").join(one_row(cost), "_one")
    return out.select("latency_pairs", "baseline_p95_ms", "candidate_p95_ms", "cost_pairs", F.when(F.col("one"), F.col("baseline_cost")).alias("baseline_average_cost"), F.when(F.col("one"), F.col("candidate_cost")).alias("candidate_average_cost"))


def evaluator_states(facts: DataFrame) -> DataFrame:
    """Counts of each state by evaluator and variant; rows without a state are unscored."""
    n = lambda s: F.count_if(F.col("state") == s)
    return facts.groupBy("evaluator", "variant").agg(
        F.count("*").alias("total"), n("passed").alias("passed"), n("failed").alias("failed"), n("error").alias("error"), n("not_applicable").alias("not_applicable"), F.count_if(F.col("state").isNull()).alias("unscored"),
    )


#: A field's several facts in a row count as the worst, which is the first of these.
RANK = ("error", "failed", "passed", "not_applicable")


def field_states(facts: DataFrame) -> DataFrame:
    """One state per case, variant, evaluator and pointer: error over failed over passed over not applicable."""
    has = {s: F.max(F.col("state").eqNullSafe(s)).alias(s) for s in RANK}
    worst = facts.groupBy("case_id", "variant", "evaluator", "pointer").agg(*has.values())
    return worst.withColumn("state", F.coalesce(*(F.when(F.col(s), F.lit(s)) for s in RANK))).drop(*RANK)


def field_hotspots(states: DataFrame) -> DataFrame:
    """Fields by what the candidate broke and mended; a side without a state is unscored.  Sorted, worst first."""
    side = lambda v: F.max(F.when(F.col("variant") == v, F.col("state")))
    both = states.groupBy("case_id", "evaluator", "pointer").agg(side("baseline").alias("b"), side("candidate").alias("c"))
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    b, c = F.col("b"), F.col("c")
    return both.groupBy("evaluator", "pointer").agg(
        n((b == "passed") & (c == "failed")).alias("regressions"), n((b == "failed") & (c == "passed")).alias("improvements"), n(c == "failed").alias("candidate_failures"),
        n(b == "error").alias("baseline_errors"), n(c == "error").alias("candidate_errors"), n(b.isNull()).alias("baseline_unscored"), n(c.isNull()).alias("candidate_unscored"),
    ).orderBy(F.desc("regressions"), F.desc("candidate_failures"), "evaluator", "pointer")


def paired_metrics(pairs: DataFrame, verdict: str, by: list[str] | None = None) -> DataFrame:
    """The four cells, margins, difference and exact McNemar p, whole or by groups."""
    # Taken out of the structs first, so that nothing else of a pair is read.
    verdicts = pairs.select(*(by or []), F.col(f"baseline.{verdict}").alias("_b"), F.col(f"candidate.{verdict}").alias("_c"))
    counts = verdicts.groupBy(*(by or [])).agg(*paired_counts(F.col("_b"), F.col("_c")))
    return counts.withColumn("mcnemar_p", F.round(mcnemar(F.col("baseline_only"), F.col("candidate_only")), 9))


def outcome_state(side: str) -> Column:
    """true, false, partial (an outcome on part of its evaluators), error, not_applicable or absent."""
    truth, full = F.col(f"{side}.truth"), F.col(f"{side}.fully_evaluated")
    return F.when(truth.isNull(), "absent").when(truth.isin(TRUE, FALSE) & ~full, "partial").otherwise(truth)


def semantic_exclusions(pairs: DataFrame) -> DataFrame:
    """Why pairs don't count in the semantic effect: the states of both sides, unless both are binary and whole."""
    b, c = outcome_state("baseline"), outcome_state("candidate")
    left = pairs.select(b.alias("b"), c.alias("c")).where(~(F.col("b").isin(TRUE, FALSE) & F.col("c").isin(TRUE, FALSE)))
    return left.groupBy(F.concat(F.lit("baseline_"), "b", F.lit("_candidate_"), "c").alias("reason")).agg(F.count("*").alias("pairs"))
