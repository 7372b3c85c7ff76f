"""The release gate: 26 rules over one row of inputs.  A rule is a row of a table, so the whole decision is a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import stats
from pairwright.operators import evidence, summary

#: Rules in their order: name, kind, input.  Kinds: groups (any are insufficient, or an error), required
#: (breached or unset is insufficient), plain (breached fails, unset is not configured), optional (also
#: insufficient where the input is unknown), each with the side of its bound.
RULES = (
    ("repeated_trial_model", "groups_insufficient", "repeated_trial_groups"),
    ("dataset_label_conflicts", "groups_error", "label_conflicts"),
    ("min_cases", "required_min", "effective_units"),
    ("min_unique_cases", "required_min", "effective_units"),
    ("max_duplicate_case_rate", "required_max", "duplicate_row_rate"),
    ("min_primary_fully_evaluated_rate", "required_min", "fully_evaluated_rate"),
    ("max_primary_component_error_rate", "required_max", "component_error_rate"),
    ("max_primary_component_not_applicable_rate", "required_max", "component_not_applicable_rate"),
    ("max_primary_component_unscored_rate", "required_max", "component_unscored_rate"),
    ("max_primary_regression_pp", "optional_max", "primary_regression_pp"),
    ("max_deployment_regression_pp", "optional_max", "deployment_regression_pp"),
    ("max_valid_but_wrong_increase_pp", "plain_max", "valid_but_wrong_increase_pp"),
    ("min_candidate_primary_success_rate", "plain_min", "candidate_primary_rate"),
    ("min_candidate_deployment_success_rate", "plain_min", "candidate_deployment_rate"),
    ("max_candidate_valid_but_wrong_rate", "plain_max", "candidate_valid_but_wrong_rate"),
    ("min_candidate_parse_validity", "plain_min", "candidate_parse_rate"),
    ("max_upper_confidence_bound_regression_pp", "optional_max", "primary_regression_bound_pp"),
    ("max_upper_confidence_bound_deployment_regression_pp", "optional_max", "deployment_regression_bound_pp"),
    ("min_discordant_pairs", "plain_min", "discordant_pairs"),
    ("min_candidate_schema_validity", "plain_min", "candidate_schema_rate"),
    ("max_error_rate", "plain_max", "error_rate"),
    ("max_timeout_rate", "plain_max", "timeout_rate"),
    ("min_matched_latency_coverage", "plain_min", "latency_coverage"),
    ("max_p95_latency_increase_percent", "optional_max", "p95_increase_percent"),
    ("min_matched_cost_coverage", "plain_min", "cost_coverage"),
    ("max_average_cost_increase_percent", "optional_max", "cost_increase_percent"),
)
INPUTS = tuple(dict.fromkeys(i for _, _, i in RULES))
#: Rules that a gate needs to tell whether a comparison stands on enough evidence, and those that hold the candidate against the baseline.
SAFEGUARDS = tuple(name for name, kind, _ in RULES if kind.startswith("required"))
RELATIVE = ("max_primary_regression_pp", "max_deployment_regression_pp", "max_valid_but_wrong_increase_pp", "max_upper_confidence_bound_regression_pp", "max_upper_confidence_bound_deployment_regression_pp")
#: The safe release profile.  A gate that authorises a deployment has limits as strict as these.
PROFILE = {
    "min_cases": 100, "min_unique_cases": 100, "max_duplicate_case_rate": 0.01, "min_primary_fully_evaluated_rate": 0.99, "max_primary_component_error_rate": 0.01,
    "max_primary_component_not_applicable_rate": 0, "max_primary_component_unscored_rate": 0, "max_deployment_regression_pp": 1, "min_candidate_deployment_success_rate": 0.95,
    "min_candidate_parse_validity": 0.99, "min_candidate_schema_validity": 0.99, "max_candidate_valid_but_wrong_rate": 0.02,
}


def lax(limits: dict[str, float]) -> list[str]:
    """Rules of the safe release profile that the limits leave out or set less strictly."""
    strict = lambda name, bound: limits[name] >= bound if name.startswith("min") else limits[name] <= bound
    return [name for name, bound in PROFILE.items() if name not in limits or not strict(name, bound)]


#: A gate's decision is the first of these that any rule has.
PRECEDENCE = ("error", "insufficient_evidence", "failed", "passed")


def relative_increase(baseline: Column, candidate: Column) -> Column:
    """Percent by which the candidate exceeds the baseline; unknown without a baseline, or with one of 0."""
    return F.when(baseline != 0, 100.0 * (candidate - baseline) / baseline)


def regression(difference_pp: Column) -> Column:
    """Points lost; unknown where the difference is."""
    return F.when(difference_pp.isNotNull(), F.greatest(-difference_pp, F.lit(0.0)))


def _judged(side: str) -> Column:
    """What the gate reads of a side, in a few numbers and flags."""
    of = lambda n: F.col(f"{side}.{n}")
    parts = of("components")
    n = lambda is_it: F.coalesce(F.size(F.filter(parts, is_it)), F.lit(0))
    size = F.coalesce(F.size(parts), F.lit(0))
    return F.struct(
        F.greatest(size, F.lit(1)).alias("required"), n(lambda x: x == "error").alias("errors"), n(lambda x: x == "not_applicable").alias("not_applicable"),
        (n(lambda x: x.isNull()) + F.when(size == 0, 1).otherwise(0)).alias("unscored"), *(of(c) for c in ("fully_evaluated", "semantic_success", "deployment_success", "valid_but_wrong", "parse_valid", "schema_valid", "latency_ms", "cost", "currency")),
        (of("status") != "ok").alias("failed"), F.coalesce(of("error_kind") == "timeout", F.lit(False)).alias("timeout"),
    ).alias(side)


def inputs(pairs: DataFrame, *, stimulus: Column, reference: Column, observation: Column, order: str = "case_id", samples: int | None = None, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row of inputs from pairs of evaluations; ``order`` tells rows apart.

    A unit of evidence is a stimulus with its reference.  Only units that count are judged, each
    by its first row: copies stand for one, repeated trials for none.  A row without components
    has one required component, which is unscored.  Without ``samples`` nothing is resampled and
    the bounds are unknown; else they are those of the bootstrap from the four counts of each effect.

    Pairs become hashes and a few numbers before anything is shuffled.  Three aggregates read the
    units; each asks for all their columns, so that Spark computes the units once.
    """
    narrow = pairs.select(order, evidence.hashed(stimulus).alias("stimulus"), evidence.hashed(stimulus, reference).alias("unit"), evidence.hashed(observation).alias("observation"), *map(_judged, ("baseline", "candidate")))
    found = evidence.represented(narrow, F.col("unit"), F.col("observation"), order, ("stimulus", "baseline", "candidate"))
    counts = F.col("kind") != "repeated_trial"
    # A unit that doesn't count has no sides, so no condition on them holds.
    sides = found.withColumns({s: F.when(counts, F.col(f"row.{s}")) for s in ("baseline", "candidate")})
    b, c = (lambda n: F.col(f"baseline.{n}")), (lambda n: F.col(f"candidate.{n}"))
    n = F.count_if(counts)
    r = lambda cond: summary.rate(F.count_if(cond), n)
    worst = lambda what: F.greatest(*(summary.rate(F.coalesce(F.sum(s(what)), F.lit(0)), F.sum(s("required"))) for s in (b, c)))
    both = b("fully_evaluated") & c("fully_evaluated")
    effect = lambda v, where: F.try_divide(100.0 * (F.count_if(where & c(v) & ~b(v)) - F.count_if(where & b(v) & ~c(v))), F.count_if(where))

    def bound(v: str, where: Column) -> Column:
        if samples is None:
            return F.lit(None).cast("double")
        lower = F.udf(lambda *cells: (stats.bootstrap(*cells, samples, confidence, seed) or (None,))[0], "double")
        return lower(*(F.count_if(where & x) for x in (b(v) & c(v), b(v) & ~c(v), ~b(v) & c(v), ~b(v) & ~c(v))))

    wrong = F.greatest(F.coalesce(F.try_divide(100.0 * (F.count_if(c("valid_but_wrong")) - F.count_if(b("valid_but_wrong"))), n), F.lit(0.0)), F.lit(0.0))
    one = sides.agg(
        *evidence.unit_counts(), r(both).alias("fully_evaluated_rate"),
        worst("errors").alias("component_error_rate"), worst("not_applicable").alias("component_not_applicable_rate"), worst("unscored").alias("component_unscored_rate"),
        F.round(regression(effect("semantic_success", both)), 9).alias("primary_regression_pp"), F.round(regression(effect("deployment_success", counts)), 9).alias("deployment_regression_pp"), F.round(wrong, 9).alias("valid_but_wrong_increase_pp"),
        r(c("semantic_success")).alias("candidate_primary_rate"), r(c("deployment_success")).alias("candidate_deployment_rate"), r(c("valid_but_wrong")).alias("candidate_valid_but_wrong_rate"), r(c("parse_valid")).alias("candidate_parse_rate"),
        bound("semantic_success", both).alias("_primary_lower"), bound("deployment_success", counts).alias("_deployment_lower"), F.count_if(both & (b("semantic_success") != c("semantic_success"))).alias("discordant_pairs"),
        r(c("schema_valid")).alias("candidate_schema_rate"), r(c("failed")).alias("error_rate"), r(c("timeout")).alias("timeout_rate"),
        r(b("latency_ms").isNotNull() & c("latency_ms").isNotNull()).alias("latency_coverage"), r(b("cost").isNotNull() & c("cost").isNotNull()).alias("cost_coverage"),
    )
    one = one.withColumns({f"{e}_regression_bound_pp": F.round(regression(F.col(f"_{e}_lower")), 9) for e in ("primary", "deployment")})
    m = summary.matched_operational(found.where(counts).select("row.*")).select(
        F.round(relative_increase(F.col("baseline_p95_ms"), F.col("candidate_p95_ms")), 9).alias("p95_increase_percent"), F.round(relative_increase(F.col("baseline_average_cost"), F.col("candidate_average_cost")), 6).alias("cost_increase_percent")
    )
    # A unit is a stimulus with one reference, so a stimulus of several units has conflicting ones.
    conflicts = found.where(F.col("rows") >= F.col("distinct_observations")).groupBy("row.stimulus").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("label_conflicts"))
    one_row = lambda df: df.withColumn("_one", F.lit(1))
    return one_row(one).join(one_row(m), "_one").join(one_row(conflicts), "_one").select(*INPUTS)


def rules(inputs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row per rule, in order: its observed value, its limit and its status.  ``inputs`` has one row."""
    strange = set(limits) - {name for name, _, _ in RULES}
    if strange:
        raise ValueError(f"no such rule: {sorted(strange)}")
    rows = [F.struct(F.lit(n).alias("place"), F.lit(name).alias("rule"), F.lit(kind).alias("kind"), F.col(source).cast("double").alias("observed"), F.lit(limits.get(name)).cast("double").alias("limit")) for n, (name, kind, source) in enumerate(RULES, 1)]
    seen, limit, kind = F.col("observed"), F.col("limit"), F.col("kind")
    breached = F.when(kind.endswith("min"), seen < limit).otherwise(seen > limit)
    bad = F.when(kind.startswith("required"), "insufficient_evidence").otherwise("failed")
    status = (
        F.when(kind == "groups_error", F.when(seen > 0, "error").otherwise("passed")).when(kind == "groups_insufficient", F.when(seen > 0, "insufficient_evidence").otherwise("passed"))
        .when(limit.isNull(), F.when(kind.startswith("required"), "insufficient_evidence").otherwise("not_configured"))
        .when(seen.isNull(), F.when(kind.startswith("plain"), "failed").otherwise("insufficient_evidence")).when(breached, bad).otherwise("passed")
    )
    return inputs.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("status", status)


def decision(found: DataFrame, *, release: bool = False) -> DataFrame:
    """One row: the decision, rules by status, and whether it authorises a deployment.

    Only a gate that may ``release``, whose limits keep to the safe release profile and which
    passes authorises one.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    # A gate without any limit decides nothing, whatever its rules found.
    first = F.when(F.count("limit") == 0, "not_configured").otherwise(F.coalesce(*(F.when(n(s) > 0, F.lit(s)) for s in PRECEDENCE), F.lit("not_configured")))
    named = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("rule")))), ",")
    bound = F.element_at(F.create_map(*(F.lit(x) for name, limit in PROFILE.items() for x in (name, float(limit)))), F.col("rule"))
    safe = F.count_if(F.when(F.col("rule").startswith("min"), F.col("limit") >= bound).otherwise(F.col("limit") <= bound)) == len(PROFILE)
    authorized = ((first == "passed") & F.lit(release) & safe).alias("deployment_authorized")
    return found.agg(first.alias("decision"), *(n(s).alias(f"n_{s}") for s in (*PRECEDENCE, "not_configured")), named("failed").alias("failed_rules"), named("insufficient_evidence").alias("insufficient_rules"), authorized)


def headline(decided: DataFrame, integrity: Column, blocking: Column, *, release: bool = False) -> DataFrame:
    """A decision's one-line title: broken evidence first, then saved cases, then what the gate found.

    ``decided`` comes from ``decision``; ``integrity`` is verified, modified, replay_failed or other,
    ``blocking`` whether the suite of saved cases blocks.
    """
    state = F.col("decision")
    # The titles.
    title = (
        F.when(integrity == "modified", "EVIDENCE MODIFIED").when(integrity == "replay_failed", "REPLAY FAILED").when(integrity != "verified", "EVIDENCE NOT VERIFIED")
        .when(blocking, "PINNED REGRESSION SUITE FAILED").when(F.col("deployment_authorized") & F.lit(release), "RELEASE AUTHORIZED").when(state == "error", "RUN ERROR")
        .when((F.col("n_failed") > 0) | (state == "failed"), "DO NOT DEPLOY").when(state == "insufficient_evidence", "NOT ENOUGH EVIDENCE")
        .when((state == "passed") & F.lit(not release), "REGRESSION CHECK PASSED").otherwise("ANALYSIS COMPLETE")
    )
    return decided.withColumn("title", title)
