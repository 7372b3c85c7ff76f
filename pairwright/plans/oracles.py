"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from pairwright.plans import reuse
from pairwright.plans.evaluations import EVALUATIONS

#: The exact p by binomial coefficients of logarithmic gamma functions.
_P = "CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2)) FOR i IN range(0, (least({b}, {c}) + 1)::BIGINT)])) END"
_MOVED = "CASE WHEN b AND c THEN 'both_pass' WHEN b THEN 'baseline_only_pass' WHEN c THEN 'candidate_only_pass' ELSE 'both_fail' END"


def _metrics(source: str, b: str, c: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""
, m AS (
  SELECT {key}count(*) AS total, count(*) FILTER (WHERE {b} AND {c}) AS both_pass, count(*) FILTER (WHERE {b} AND NOT {c}) AS baseline_only, count(*) FILTER (WHERE NOT {b} AND {c}) AS candidate_only,
         count(*) FILTER (WHERE NOT {b} AND NOT {c}) AS both_fail, count(*) FILTER (WHERE {b}) AS baseline_pass, count(*) FILTER (WHERE {c}) AS candidate_pass FROM {source} {f"GROUP BY {by}" if by else ""}
) SELECT *, round(100.0::DOUBLE * (candidate_only - baseline_only) / total, 9) AS difference_pp, round({_P.format(b="baseline_only", c="candidate_only")}, 9) AS mcnemar_p FROM m"""


def _rate(cond: str) -> str:
    return f"round(count(*) FILTER (WHERE {cond}) / count(*)::DOUBLE, 9)"


_UNITS = """
WITH d AS (SELECT doc_id, text, lang, source, concat(coalesce(lang, '?'), chr(0), coalesce(source, '?')) AS seen FROM documents), u AS (
  SELECT text, count(*) AS rows, count(DISTINCT seen) AS seen, min(doc_id) AS first FROM d GROUP BY text
), g AS (SELECT *, CASE WHEN rows = 1 THEN 'singleton' WHEN seen = 1 THEN 'exact_duplicate' ELSE 'repeated_trial' END AS kind FROM u)
"""

_FACTS = (
    EVALUATIONS
    + """, facts AS (
  SELECT k, variant, x.evaluator, '/' || x.evaluator AS pointer, CASE WHEN x.evaluator = 'cents' AND k % 43 = 0 THEN NULL ELSE x.state END AS state
  FROM f, LATERAL (SELECT unnest([{'evaluator': 'priority', 'state': priority_state}, {'evaluator': 'status', 'state': status_state}, {'evaluator': 'cents', 'state': cents_state}]) AS x)
), hot AS (
  SELECT b.evaluator, b.pointer, count(*) FILTER (WHERE b.state = 'passed' AND c.state = 'failed') AS regressions, count(*) FILTER (WHERE b.state = 'failed' AND c.state = 'passed') AS improvements,
         count(*) FILTER (WHERE c.state = 'failed') AS candidate_failures, count(*) FILTER (WHERE b.state = 'error') AS baseline_errors, count(*) FILTER (WHERE c.state = 'error') AS candidate_errors,
         count(*) FILTER (WHERE b.state IS NULL) AS baseline_unscored, count(*) FILTER (WHERE c.state IS NULL) AS candidate_unscored
  FROM facts b JOIN facts c ON b.k = c.k AND b.evaluator = c.evaluator WHERE b.variant = 'baseline' AND c.variant = 'candidate' GROUP BY 1, 2
)"""
)

_SUMMARY = """
, vs AS (
  SELECT variant, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'missing') AS missing,
    count(*) FILTER (WHERE error_kind = 'timeout') AS timeouts, count(*) FILTER (WHERE parse_valid) AS parse_valid, count(*) FILTER (WHERE schema_valid) AS schema_valid, count(*) FILTER (WHERE schema_valid AND status = 'ok') AS structured_success,
    count(*) FILTER (WHERE semantic) AS semantic_success, count(*) FILTER (WHERE deployed) AS deployment_success, count(*) FILTER (WHERE wrong) AS valid_but_wrong, count(*) FILTER (WHERE fully_evaluated) AS fully_evaluated,
    3 * count(*) AS required_components, 3 * count(*) FILTER (WHERE NOT parse_valid) AS error_components, 0::BIGINT AS not_applicable_components, 0::BIGINT AS unscored_components FROM f GROUP BY variant
)"""

_GATE = f"""
, t AS (
  SELECT list_sort(list(bl))[ceil((count(*) - 1) * 0.95)::BIGINT + 1] AS bp95, list_sort(list(cl))[ceil((count(*) - 1) * 0.95)::BIGINT + 1] AS cp95 FROM pr WHERE bl IS NOT NULL AND cl IS NOT NULL
), pay AS (
  SELECT round(sum(bc)::DOUBLE / count(*), 9) AS ba, round(sum(cc)::DOUBLE / count(*), 9) AS ca FROM pr WHERE bc IS NOT NULL AND cc IS NOT NULL
), g AS (
  SELECT 0::BIGINT AS repeated_trial_groups, 0::BIGINT AS label_conflicts, count(*) AS effective_units, 0.0::DOUBLE AS duplicate_row_rate, {_rate("bp AND cp")} AS fully_evaluated_rate,
    greatest({_rate("NOT bp")}, {_rate("NOT cp")}) AS component_error_rate, 0.0::DOUBLE AS component_not_applicable_rate, 0.0::DOUBLE AS component_unscored_rate,
    round(greatest(-100.0::DOUBLE * (count(*) FILTER (WHERE bp AND cp AND c AND NOT b) - count(*) FILTER (WHERE bp AND cp AND b AND NOT c)) / count(*) FILTER (WHERE bp AND cp), 0), 9) AS primary_regression_pp,
    round(greatest(-100.0::DOUBLE * (count(*) FILTER (WHERE cd AND NOT bd) - count(*) FILTER (WHERE bd AND NOT cd)) / count(*), 0), 9) AS deployment_regression_pp,
    round(greatest(100.0::DOUBLE * (count(*) FILTER (WHERE cw) - count(*) FILTER (WHERE bw)) / count(*), 0), 9) AS valid_but_wrong_increase_pp,
    {_rate("c")} AS candidate_primary_rate, {_rate("cd")} AS candidate_deployment_rate, {_rate("cw")} AS candidate_valid_but_wrong_rate, {_rate("cp")} AS candidate_parse_rate,
    NULL::DOUBLE AS primary_regression_bound_pp, NULL::DOUBLE AS deployment_regression_bound_pp, count(*) FILTER (WHERE bp AND cp AND b <> c) AS discordant_pairs,
    {_rate("cs")} AS candidate_schema_rate, {_rate("cst <> 'ok'")} AS error_rate, {_rate("cek = 'timeout'")} AS timeout_rate, {_rate("bl IS NOT NULL AND cl IS NOT NULL")} AS latency_coverage,
    any_value(round(100.0::DOUBLE * (t.cp95 - t.bp95) / t.bp95, 9)) AS p95_increase_percent, {_rate("bc IS NOT NULL AND cc IS NOT NULL")} AS cost_coverage, any_value(round(100.0::DOUBLE * (pay.ca - pay.ba) / pay.ba, 6)) AS cost_increase_percent
  FROM pr, t, pay
)"""

_RULES = """
, r(place, rule, kind, observed, lim) AS (
  SELECT x.* FROM g, LATERAL (VALUES
    (1, 'repeated_trial_model', 'gi', g.repeated_trial_groups::DOUBLE, NULL::DOUBLE), (2, 'dataset_label_conflicts', 'ge', g.label_conflicts, NULL), (3, 'min_cases', 'rmin', g.effective_units, 1000), (4, 'min_unique_cases', 'rmin', g.effective_units, 1000),
    (5, 'max_duplicate_case_rate', 'rmax', g.duplicate_row_rate, 0.1), (6, 'min_primary_fully_evaluated_rate', 'rmin', g.fully_evaluated_rate, 0.9), (7, 'max_primary_component_error_rate', 'rmax', g.component_error_rate, 0.05),
    (8, 'max_primary_component_not_applicable_rate', 'rmax', g.component_not_applicable_rate, 0), (9, 'max_primary_component_unscored_rate', 'rmax', g.component_unscored_rate, 0), (10, 'max_primary_regression_pp', 'omax', g.primary_regression_pp, 1),
    (11, 'max_deployment_regression_pp', 'omax', g.deployment_regression_pp, NULL), (12, 'max_valid_but_wrong_increase_pp', 'pmax', g.valid_but_wrong_increase_pp, 0.5), (13, 'min_candidate_primary_success_rate', 'pmin', g.candidate_primary_rate, 0.5),
    (14, 'min_candidate_deployment_success_rate', 'pmin', g.candidate_deployment_rate, NULL), (15, 'max_candidate_valid_but_wrong_rate', 'pmax', g.candidate_valid_but_wrong_rate, NULL), (16, 'min_candidate_parse_validity', 'pmin', g.candidate_parse_rate, 0.99),
    (17, 'max_upper_confidence_bound_regression_pp', 'omax', g.primary_regression_bound_pp, NULL), (18, 'max_upper_confidence_bound_deployment_regression_pp', 'omax', g.deployment_regression_bound_pp, NULL), (19, 'min_discordant_pairs', 'pmin', g.discordant_pairs, 10),
    (20, 'min_candidate_schema_validity', 'pmin', g.candidate_schema_rate, NULL), (21, 'max_error_rate', 'pmax', g.error_rate, 0.02), (22, 'max_timeout_rate', 'pmax', g.timeout_rate, 0.01), (23, 'min_matched_latency_coverage', 'pmin', g.latency_coverage, 1),
    (24, 'max_p95_latency_increase_percent', 'omax', g.p95_increase_percent, 10), (25, 'min_matched_cost_coverage', 'pmin', g.cost_coverage, NULL), (26, 'max_average_cost_increase_percent', 'omax', g.cost_increase_percent, 5)) AS x
), rs AS (
  SELECT place::INTEGER AS place, rule, observed, lim AS "limit", CASE WHEN kind = 'ge' THEN CASE WHEN observed > 0 THEN 'error' ELSE 'passed' END WHEN kind = 'gi' THEN CASE WHEN observed > 0 THEN 'insufficient_evidence' ELSE 'passed' END
    WHEN lim IS NULL THEN CASE WHEN kind LIKE 'r%' THEN 'insufficient_evidence' ELSE 'not_configured' END WHEN observed IS NULL THEN CASE WHEN kind LIKE 'p%' THEN 'failed' ELSE 'insufficient_evidence' END
    WHEN CASE WHEN kind LIKE '%min' THEN observed < lim ELSE observed > lim END THEN CASE WHEN kind LIKE 'r%' THEN 'insufficient_evidence' ELSE 'failed' END ELSE 'passed' END AS status FROM r
)"""

#: The gate over planted faults: a component without a state takes the verdicts, copies count once, repeated trials not at all.
_FAULTY = f"""
, q AS (
  SELECT k, 'as is' AS reference, b AND NOT bu AS b, c AND NOT cu AS c, bd AND NOT bu AS bd, cd AND NOT cu AS cd, bw AND NOT bu AS bw, cw AND NOT cu AS cw, bp AND NOT bu AS bf, cp AND NOT cu AS cf,
         bu, cu, bp, cp, cs, cst, cek, bl, cl, bc, cc FROM (SELECT *, k % 41 = 0 AS bu, k % 8 = 0 AS cu FROM pr)
), rw AS (
  SELECT * FROM q UNION ALL SELECT * FROM q WHERE k % 50 = 3 UNION ALL SELECT * REPLACE (cl + 1 AS cl) FROM q WHERE k % 70 = 4 UNION ALL SELECT * REPLACE ('other' AS reference) FROM q WHERE k % 90 = 5
), un AS (
  SELECT k, reference, count(*) AS n, count(DISTINCT cl) AS seen FROM rw GROUP BY ALL
), ev AS (
  SELECT count(*) FILTER (WHERE seen > 1) AS repeated, count(*) FILTER (WHERE seen = 1) AS effective, coalesce(sum(n - 1) FILTER (WHERE seen = 1), 0) / sum(n)::DOUBLE AS copied FROM un
), lc AS (
  SELECT count(*) AS conflicts FROM (SELECT k FROM rw GROUP BY k HAVING count(DISTINCT reference) > 1)
), rep AS (
  SELECT DISTINCT rw.* FROM rw JOIN un ON rw.k = un.k AND rw.reference = un.reference WHERE seen = 1
), t AS (
  SELECT list_sort(list(bl))[ceil((count(*) - 1) * 0.95)::BIGINT + 1] AS bp95, list_sort(list(cl))[ceil((count(*) - 1) * 0.95)::BIGINT + 1] AS cp95 FROM rep WHERE bl IS NOT NULL AND cl IS NOT NULL
), pay AS (
  SELECT round(sum(bc)::DOUBLE / count(*), 9) AS ba, round(sum(cc)::DOUBLE / count(*), 9) AS ca FROM rep WHERE bc IS NOT NULL AND cc IS NOT NULL
), g AS (
  SELECT any_value(repeated) AS repeated_trial_groups, any_value(conflicts) AS label_conflicts, any_value(effective) AS effective_units, any_value(round(copied, 9)) AS duplicate_row_rate, {_rate("bf AND cf")} AS fully_evaluated_rate,
    round(greatest(sum(CASE WHEN bp THEN 0 WHEN bu THEN 2 ELSE 3 END), sum(CASE WHEN cp THEN 0 WHEN cu THEN 2 ELSE 3 END)) / (3.0::DOUBLE * count(*)), 9) AS component_error_rate, 0.0::DOUBLE AS component_not_applicable_rate,
    round(greatest(count(*) FILTER (WHERE bu), count(*) FILTER (WHERE cu)) / (3.0::DOUBLE * count(*)), 9) AS component_unscored_rate,
    round(greatest(-100.0::DOUBLE * (count(*) FILTER (WHERE bf AND cf AND c AND NOT b) - count(*) FILTER (WHERE bf AND cf AND b AND NOT c)) / count(*) FILTER (WHERE bf AND cf), 0), 9) AS primary_regression_pp,
    round(greatest(-100.0::DOUBLE * (count(*) FILTER (WHERE cd AND NOT bd) - count(*) FILTER (WHERE bd AND NOT cd)) / count(*), 0), 9) AS deployment_regression_pp,
    round(greatest(100.0::DOUBLE * (count(*) FILTER (WHERE cw) - count(*) FILTER (WHERE bw)) / count(*), 0), 9) AS valid_but_wrong_increase_pp,
    {_rate("c")} AS candidate_primary_rate, {_rate("cd")} AS candidate_deployment_rate, {_rate("cw")} AS candidate_valid_but_wrong_rate, {_rate("cp")} AS candidate_parse_rate, count(*) FILTER (WHERE bf AND cf AND b <> c) AS discordant_pairs,
    {_rate("cs")} AS candidate_schema_rate, {_rate("cst <> 'ok'")} AS error_rate, {_rate("cek = 'timeout'")} AS timeout_rate, {_rate("bl IS NOT NULL AND cl IS NOT NULL")} AS latency_coverage,
    any_value(round(100.0::DOUBLE * (t.cp95 - t.bp95) / t.bp95, 9)) AS p95_increase_percent, {_rate("bc IS NOT NULL AND cc IS NOT NULL")} AS cost_coverage, any_value(round(100.0::DOUBLE * (pay.ca - pay.ba) / pay.ba, 6)) AS cost_increase_percent
  FROM rep, ev, lc, t, pay
)"""


def _lower(b: str, c: str, where: str) -> str:
    """Points lost at the lower end of the normal interval, which the bootstrap's comes near."""
    d = f"(({c})::INT - ({b})::INT)"
    return f"(SELECT greatest(-100.0::DOUBLE * (avg({d}) - 1.959964 * stddev_pop({d}) / sqrt(count(*))), 0) FROM rep WHERE {where})"


#: Both bounds from normal intervals: the limits, 5 points, are far from them.
_BOUNDS = f", g2 AS (SELECT *, {_lower('b', 'c', 'bf AND cf')} AS primary_regression_bound_pp, {_lower('bd', 'cd', 'true')} AS deployment_regression_bound_pp FROM g)"
_FAULTY_RULES = _RULES.replace("FROM g, LATERAL", "FROM g2 AS g, LATERAL").replace("_regression_bound_pp, NULL)", "_regression_bound_pp, 5)")


def _evaluated(select: str) -> str:
    return EVALUATIONS + select


def _likeness(value: str) -> str:
    return f"CASE WHEN {value} THEN 'passed' ELSE 'failed' END"


ORACLES = {
    "denominator_join": _evaluated("SELECT k, status, error_kind, latency_ms FROM f WHERE variant = 'baseline'"),
    "unknown_output_ids": _evaluated("SELECT status, count(*) AS strangers FROM f WHERE variant = 'candidate' AND k % 5 = 0 GROUP BY 1"),
    "id_coverage": _evaluated(""", l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT count(*) FILTER (WHERE f.k % 97 <> 0 AND l.n IS NOT NULL) AS matched, count(*) FILTER (WHERE f.k % 97 = 0) AS missing_baseline, count(*) FILTER (WHERE l.n IS NULL) AS missing_candidate, 0::BIGINT AS repeated_baseline,
        count(*) FILTER (WHERE l.n > 1) AS repeated_candidate FROM f LEFT JOIN l ON l.k = f.k WHERE variant = 'baseline'"""),
    "execution_tokens": "SELECT o_orderkey AS k, 'case-' || substr(sha256('run-1' || chr(0) || o_orderkey), 1, 24) AS token FROM orders",
    "parse_status_counts": _evaluated("SELECT variant, status, parse_valid, count(*) AS n FROM f GROUP BY ALL"),
    "schema_validity": _evaluated("SELECT variant, count(*) FILTER (WHERE schema_valid) AS valid, count(*) FILTER (WHERE parse_valid AND NOT schema_valid) AS parsed_but_invalid FROM f GROUP BY 1"),
    "pointer_exact": _evaluated("SELECT variant, priority_state AS state, count(*) AS n FROM f GROUP BY ALL"),
    "pointers_exact": _evaluated("SELECT variant, CASE truth WHEN 'true' THEN 'passed' WHEN 'false' THEN 'failed' ELSE 'error' END AS state, count(*) AS n FROM f GROUP BY ALL"),
    "enum_accuracy": _evaluated("SELECT variant, ostatus AS label, count(*) FILTER (WHERE status_state = 'passed') AS \"right\", count(*) AS n FROM f GROUP BY ALL"),
    "exact_json": _evaluated("SELECT variant, CASE truth WHEN 'true' THEN 'passed' WHEN 'false' THEN 'failed' ELSE 'error' END AS state, count(*) AS n FROM f GROUP BY ALL"),
    "tool_selection": "SELECT event_type, CASE WHEN event_id % 10 = 0 AND event_type <> 'other' THEN 'failed' ELSE 'passed' END AS state, count(*) AS n FROM events GROUP BY ALL",
    "tool_arguments": "SELECT CASE WHEN event_id % 4 = 0 THEN 'error' WHEN event_id % 6 = 0 THEN 'failed' ELSE 'passed' END AS state, count(*) AS n FROM events GROUP BY 1",
    "normalized_string": f"SELECT {_likeness('p_partkey % 9 <> 0')} AS state, {_likeness('p_partkey % 9 <> 0 AND upper(p_name) = p_name')} AS state_with_case, count(*) AS n FROM part GROUP BY ALL",
    "canonical_date": f"SELECT {_likeness('o_orderkey % 10 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0)')} AS state, count(*) AS n FROM orders GROUP BY 1",
    "numeric_absolute": f"SELECT l_linenumber, {_likeness('l_linenumber <= 3 AND l_partkey % 7 <> 0')} AS state, count(*) AS n FROM lineitem GROUP BY ALL",
    "numeric_relative": f"SELECT l_linenumber, {_likeness('l_linenumber <= 3')} AS state, count(*) AS n FROM lineitem GROUP BY ALL",
    "exact_integer": f"SELECT {_likeness('p_partkey % 5 = 0 OR (p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)')} AS state, count(*) AS n FROM part GROUP BY 1",
    "required_fields": f"SELECT event_type, {_likeness('event_id % 8 <> 0 AND event_id % 9 <> 0')} AS state, count(*) AS n FROM events GROUP BY ALL",
    "keyed_array_match": """
WITH e AS (SELECT l_orderkey AS o, l_linenumber AS l, l_quantity::DECIMAL(12,2) AS q, l_partkey AS p FROM lineitem), a AS (SELECT o, l, CASE WHEN p % 17 = 0 THEN q + 1 ELSE q END AS q, p FROM e WHERE p % 23 <> 0),
bad AS (SELECT o, bool_or(n > 1) AS bad_e FROM (SELECT o, l, count(*) AS n FROM e GROUP BY ALL) GROUP BY o), bada AS (SELECT o, bool_or(n > 1) AS bad_a FROM (SELECT o, l, count(*) AS n FROM a GROUP BY ALL) GROUP BY o),
j AS (SELECT e.o, count(*) FILTER (WHERE a.l IS NULL) AS missing, count(*) FILTER (WHERE a.l IS NOT NULL AND (abs(e.q - a.q) > 0.5 OR e.p <> a.p)) AS mismatched FROM e LEFT JOIN a ON a.o = e.o AND a.l = e.l GROUP BY 1),
s AS (SELECT CASE WHEN bad_e THEN 'error' WHEN coalesce(bad_a, false) THEN 'failed' WHEN missing + mismatched = 0 THEN 'passed' ELSE 'failed' END AS status, NOT bad_e AND NOT coalesce(bad_a, false) AS ok, missing, mismatched FROM bad JOIN j USING (o) LEFT JOIN bada USING (o))
SELECT status, count(*) AS orders, coalesce(sum(missing) FILTER (WHERE ok), 0)::BIGINT AS missing, coalesce(sum(mismatched) FILTER (WHERE ok), 0)::BIGINT AS mismatched FROM s GROUP BY 1""",
    "keyed_array_duplicate_keys": """WITH n AS (SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS r FROM lineitem GROUP BY 1)
SELECT CASE WHEN r > 0 THEN 'error' ELSE 'passed' END AS status, count(*) AS orders, sum(r)::BIGINT AS repeats FROM n GROUP BY 1""",
    "plan_line_documents": """
WITH li AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS p FROM lineitem), o AS (
  SELECT k, count(*) > count(DISTINCT line) AS bad, bool_or(p % 23 = 0) AS lost, bool_or(p % 17 = 0) AS changed, bool_and(p % 23 = 0) AS bare,
         coalesce(bool_or(p % 37 = 0) FILTER (WHERE p % 23 <> 0), false) AS words, coalesce(bool_or(p % 41 = 0) FILTER (WHERE p % 23 <> 0), false) AS off FROM li GROUP BY k
), s AS (
  SELECT k, CASE WHEN bad THEN 'error' WHEN lost OR changed THEN 'failed' ELSE 'passed' END AS items_state,
         CASE WHEN words THEN 'error' WHEN off OR k % 10 = 0 THEN 'failed' ELSE 'passed' END AS sums_state,
         CASE WHEN bare THEN 'failed' ELSE 'passed' END AS needed_state, CASE WHEN k % 9 = 0 THEN 'failed' ELSE 'passed' END AS head_state FROM o
)
SELECT *, CASE WHEN 'failed' IN (items_state, sums_state) THEN 'false' WHEN 'error' IN (items_state, sums_state) THEN 'error' ELSE 'true' END AS truth,
       'error' NOT IN (items_state, sums_state) AS fully_evaluated FROM s""",
    "financial_invariants": """
WITH o AS (SELECT l_orderkey AS k, bool_or(l_partkey % 37 = 0) AS open, bool_or(l_partkey % 41 = 0 AND l_partkey % 37 <> 0) AS off, count(*) FILTER (WHERE l_partkey % 37 <> 0) AS n FROM lineitem GROUP BY 1)
SELECT CASE WHEN open THEN 'error' WHEN off OR k % 10 = 0 THEN 'failed' ELSE 'passed' END AS status, count(*) AS orders FROM o GROUP BY 1""",
    "reference_preflight": "SELECT o_orderkey AS k, unnest(['priority', 'cents']) AS evaluator, 'error' AS state FROM orders WHERE o_orderkey % 29 = 0",
    "outcome_all_of": _evaluated("SELECT variant, truth, fully_evaluated, count(*) AS n FROM f GROUP BY ALL"),
    "outcome_any_of": _evaluated("SELECT variant, any_truth AS truth, count(*) AS n FROM f GROUP BY ALL"),
    "case_evaluation_flags": _evaluated("SELECT k, variant, schema_valid AND status = 'ok' AS structured_success, semantic AS semantic_success, deployed AS deployment_success, wrong AS valid_but_wrong, wrong AND fully_evaluated AS fully_evaluated_valid_but_wrong FROM f"),
    "external_evaluator": _evaluated(""", x AS (
  SELECT variant, priority_state AS p, CASE WHEN k % 5 = 0 OR k % 31 = 0 OR status = 'missing' THEN 'error' WHEN status = 'ok' THEN 'passed' ELSE 'not_applicable' END AS status FROM f
) SELECT variant, status, CASE WHEN p = 'failed' THEN 'false' WHEN p = 'error' OR status = 'error' THEN 'error' WHEN status = 'not_applicable' THEN 'not_applicable' ELSE 'true' END AS truth, count(*) AS n FROM x GROUP BY ALL"""),
    "transitions": _evaluated(f"SELECT {_MOVED} AS transition, count(*) AS n FROM pr GROUP BY 1"),
    "semantic_transitions": _evaluated(f"SELECT CASE WHEN bp AND cp THEN {_MOVED} END AS transition, count(*) AS n FROM pr GROUP BY 1"),
    "paired_metrics": _evaluated(_metrics("pr", "b", "c")),
    "deployment_metrics": _evaluated(_metrics("pr", "bd", "cd")),
    "paired_by_segment": _evaluated(", seg AS (SELECT pr.*, c_mktsegment AS segment FROM pr JOIN customer ON c_custkey = custkey)" + _metrics("seg", "b", "c", "segment")),
    "mcnemar_exact": _evaluated(f", n AS (SELECT custkey, count(*) FILTER (WHERE b AND NOT c) AS losses, count(*) FILTER (WHERE c AND NOT b) AS wins FROM pr GROUP BY ROLLUP (custkey)) SELECT custkey, losses, wins, round({_P.format(b='losses', c='wins')} + 1e-12, 9) AS p FROM n"),
    "variant_summary": _evaluated(_SUMMARY + "SELECT * FROM vs"),
    "operational_summary": _evaluated("""SELECT variant, count(latency_ms) AS latency_rows, round(avg(latency_ms), 6) AS mean_ms, sum(retries)::BIGINT AS retries, count(input_tokens) AS usage_rows, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
        (list_sort(list(latency_ms) FILTER (WHERE latency_ms IS NOT NULL)))[ceil((count(latency_ms) - 1) * 0.5)::BIGINT + 1] AS median_ms, (list_sort(list(latency_ms) FILTER (WHERE latency_ms IS NOT NULL)))[ceil((count(latency_ms) - 1) * 0.95)::BIGINT + 1] AS p95_ms FROM f GROUP BY 1"""),
    "matched_operational": _evaluated(_GATE + "SELECT (SELECT count(*) FROM pr WHERE bl IS NOT NULL AND cl IS NOT NULL) AS latency_pairs, bp95 AS baseline_p95_ms, cp95 AS candidate_p95_ms, (SELECT count(*) FROM pr WHERE bc IS NOT NULL AND cc IS NOT NULL) AS cost_pairs, ba AS baseline_average_cost, ca AS candidate_average_cost FROM t, pay"),
    "cost_by_currency": _evaluated("""SELECT variant, CASE variant WHEN 'baseline' THEN 1 ELSE 2 END::BIGINT AS currencies, variant = 'candidate' AS mixed_currencies, count(*) AS cost_rows, CASE variant WHEN 'baseline' THEN 'USD' END AS currency,
        CASE variant WHEN 'baseline' THEN round(sum(cost)::DOUBLE, 6) END AS total_cost, CASE variant WHEN 'baseline' THEN round(sum(cost)::DOUBLE / count(*), 9) END AS average_cost FROM f WHERE cost IS NOT NULL GROUP BY 1"""),
    "evaluator_state_counts": _FACTS + """SELECT evaluator, variant, count(*) AS total, count(*) FILTER (WHERE state = 'passed') AS passed, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'error') AS error, 0::BIGINT AS not_applicable, count(*) FILTER (WHERE state IS NULL) AS unscored FROM facts GROUP BY ALL""",
    "field_hotspots": _FACTS + "SELECT * FROM hot",
    "hotspot_rollup": _FACTS + "SELECT pointer, sum(regressions)::BIGINT AS regressions, sum(improvements)::BIGINT AS improvements FROM hot GROUP BY 1",
    "semantic_effect_exclusions": _evaluated("SELECT 'baseline_' || bt || '_candidate_' || ct AS reason, count(*) AS pairs FROM pr WHERE NOT (bp AND cp) GROUP BY 1"),
    "study_metrics": _evaluated(", sg AS (SELECT c_mktsegment AS id, count(*) FILTER (WHERE b AND c) AS bp, count(*) FILTER (WHERE b AND NOT c) AS bo, count(*) FILTER (WHERE c AND NOT b) AS co, count(*) FILTER (WHERE NOT b AND NOT c) AS bf FROM pr JOIN customer ON c_custkey = custkey GROUP BY 1) SELECT id, bp + bo + co + bf AS total, bp AS both_pass, bo AS baseline_only, co AS candidate_only, bf AS both_fail, bp + bo AS baseline_pass, bp + co AS candidate_pass, round(100.0::DOUBLE * (co - bo) / (bp + bo + co + bf), 9) AS difference_pp, round(" + _P.format(b="bo", c="co") + ", 9) AS mcnemar_p FROM sg"),
    "evidence_groups": _UNITS + "SELECT kind, count(*) AS units, sum(rows)::BIGINT AS rows FROM g GROUP BY 1",
    "evidence_summary": _UNITS + """SELECT sum(rows)::BIGINT AS total_rows, count(*) AS units, count(*) FILTER (WHERE kind = 'singleton') AS singletons, count(*) FILTER (WHERE kind = 'exact_duplicate') AS duplicate_groups, count(*) FILTER (WHERE kind = 'repeated_trial') AS repeated_trial_groups,
        coalesce(sum(rows - 1) FILTER (WHERE kind = 'exact_duplicate'), 0)::BIGINT AS exact_duplicate_rows, max(rows)::BIGINT AS largest_group, count(*) FILTER (WHERE kind <> 'repeated_trial') AS effective_units, round(coalesce(sum(rows - 1) FILTER (WHERE kind = 'exact_duplicate'), 0) / sum(rows)::DOUBLE, 9) AS duplicate_row_rate FROM g""",
    "independent_population": _UNITS + "SELECT doc_id, lang, source FROM d JOIN g ON g.text IS NOT DISTINCT FROM d.text AND d.doc_id = g.first WHERE kind <> 'repeated_trial'",
    "label_conflicts": "SELECT count(DISTINCT quality) AS n_references, count(*) AS n_rows FROM documents JOIN labels USING (doc_id) GROUP BY text HAVING count(DISTINCT quality) > 1",
    "evidence_collisions": "SELECT count(*) AS rows, count(DISTINCT event_type || chr(0) || props) AS distinct_stimuli, count(*) - count(DISTINCT event_type || chr(0) || props) AS colliding_rows FROM events",
    "gate_inputs": _evaluated(_GATE + "SELECT * FROM g"),
    "gate_rules": _evaluated(_GATE + _RULES + "SELECT * FROM rs"),
    "gate_inputs_faulty": _evaluated(_FAULTY + "SELECT * FROM g"),
    "gate_rules_faulty": _evaluated(_FAULTY + _BOUNDS + _FAULTY_RULES + 'SELECT place, rule, "limit", status FROM rs'),
    "gate_decision": _evaluated(_GATE + _RULES + """SELECT CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'insufficient_evidence') THEN 'insufficient_evidence' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'passed' END AS decision,
        count(*) FILTER (WHERE status = 'error') AS n_error, count(*) FILTER (WHERE status = 'insufficient_evidence') AS n_insufficient_evidence, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'passed') AS n_passed, count(*) FILTER (WHERE status = 'not_configured') AS n_not_configured,
        coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE status = 'failed'), '') AS failed_rules, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE status = 'insufficient_evidence'), '') AS insufficient_rules,
        NOT bool_or(status IN ('error', 'insufficient_evidence', 'failed')) AS deployment_authorized FROM rs"""),
    "case_filters": _evaluated("""SELECT filter, count(*) AS cases FROM (SELECT unnest(list_filter([CASE WHEN b AND NOT c THEN 'regressions' END, CASE WHEN c AND NOT b THEN 'improvements' END, CASE WHEN NOT b AND NOT c THEN 'both_wrong' END, CASE WHEN bw OR cw THEN 'valid_but_wrong' END,
        CASE WHEN NOT bp OR NOT cp THEN 'parse_failures' END, CASE WHEN (bp AND NOT bs) OR (cp AND NOT cs) THEN 'schema_failures' END, CASE WHEN bt = 'error' OR ct = 'error' THEN 'evaluator_errors' END, CASE WHEN bst <> 'ok' OR cst <> 'ok' THEN 'adapter_errors' END], lambda x: x IS NOT NULL)) AS filter FROM pr) GROUP BY 1"""),
    "case_page": _evaluated("SELECT k, 'baseline_only_pass' AS transition FROM pr WHERE b AND NOT c ORDER BY k LIMIT 50 OFFSET 20"),
    "case_search": "SELECT o_orderkey AS k FROM orders WHERE contains(lower(o_orderpriority), '1-urgent')",
    "discordances": _evaluated("SELECT k, bt AS baseline_truth, ct AS candidate_truth FROM pr WHERE b <> c OR bw OR cw"),
    "report_chunks": "SELECT (o_orderkey // 50)::BIGINT AS chunk, count(*) AS cases, min(o_orderkey % 50)::BIGINT AS first, max(o_orderkey % 50)::BIGINT AS last FROM orders GROUP BY 1",
    "leakage_scan": "SELECT event_type, count(*) AS leaks FROM events WHERE (event_id % 100)::VARCHAR IN (event_type, json_extract_string(props, '$.k'), 'x') GROUP BY 1",
    "suspicious_ids": "SELECT event_type, count(*) FILTER (WHERE event_id % 4 = 0) AS suspicious, count(*) AS n FROM events GROUP BY 1",
    "json_diff": _evaluated(""", v AS (SELECT * FROM pr WHERE bp AND cp), d AS (
        SELECT '/priority' AS path, 'value_changed' AS kind FROM v WHERE b_bp <> c_bp UNION ALL SELECT '/status', 'removed' FROM v WHERE c_no_status UNION ALL SELECT '/cents', 'value_changed' FROM v WHERE b_bc <> c_bc)
        SELECT path, kind, count(*) AS n FROM d GROUP BY ALL"""),
    "redaction": "SELECT conv_id, turn, md5(CASE WHEN text = role THEN '[redacted]' WHEN length(role) >= 4 THEN replace(text, role, '[redacted]') ELSE text END) AS digest, md5('[redacted]') AS whole FROM conversations",
    "log_sanitizer": "SELECT event_id, 'start ' || event_type || chr(10) || CASE WHEN event_id % 3 = 0 THEN '[redacted]' ELSE props END || chr(10) || 'end' AS log FROM events",
    "log_budget": """WITH s AS (SELECT user_id AS run_id, octet_length(props::BLOB) AS n, greatest(0, 500 - coalesce(sum(octet_length(props::BLOB)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remaining FROM events)
        SELECT run_id, sum(least(n, remaining))::BIGINT AS kept_bytes, count(*) FILTER (WHERE remaining = 0) AS left_out FROM s GROUP BY 1""",
    "replay_diff": _evaluated("SELECT k, CASE WHEN k % 101 = 0 THEN 'lost' ELSE 'changed' END AS mismatch FROM f WHERE variant = 'baseline' AND (k % 101 = 0 OR (k % 71 = 0 AND truth <> 'error'))"),
    "pin_status": _evaluated("""SELECT k, CASE WHEN k % 15 = 0 THEN 'missing' WHEN c AND b THEN 'passing' WHEN c THEN 'fixed' WHEN b OR k % 2 = 0 THEN 'reintroduced' ELSE 'still_broken' END AS suite_status FROM pr"""),
    "suite_summary": _evaluated(""", q AS (SELECT CASE WHEN k % 15 = 0 THEN 'missing' WHEN c AND b THEN 'passing' WHEN c THEN 'fixed' WHEN b OR k % 2 = 0 THEN 'reintroduced' ELSE 'still_broken' END AS s FROM pr)
        SELECT count(*) AS total, count(*) FILTER (WHERE s = 'passing') AS passing, count(*) FILTER (WHERE s = 'fixed') AS fixed, count(*) FILTER (WHERE s = 'still_broken') AS still_broken, count(*) FILTER (WHERE s = 'reintroduced') AS reintroduced, count(*) FILTER (WHERE s = 'missing') AS missing, bool_or(s IN ('reintroduced', 'missing')) AS blocking FROM q"""),
    "pin_history": """WITH r AS (SELECT l_orderkey AS pin_id, l_linenumber AS run_id, max(l_partkey) % 2 = 0 AS passes, l_orderkey % 2 = 0 AS origin FROM lineitem GROUP BY ALL), h AS (
        SELECT *, lag(passes) OVER w AS last FROM r WINDOW w AS (PARTITION BY pin_id ORDER BY run_id))
        SELECT pin_id, run_id, CASE WHEN passes AND origin THEN 'passing' WHEN passes THEN 'fixed' WHEN origin OR coalesce(last, false) THEN 'reintroduced' ELSE 'still_broken' END AS suite_status FROM h""",
    "run_selector": "SELECT o_orderpriority AS kind, lpad(max(o_orderkey)::VARCHAR, 12, '0') AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "cost_pricing": "SELECT lang, round(sum(n_chars::DECIMAL(18,0) * 3 + floor(n_chars / 4.0)::DECIMAL(18,0) * 15)::DOUBLE / 1000000, 6) AS cost FROM documents GROUP BY 1",
    "summary_rows": _evaluated(_SUMMARY + ", u AS (UNPIVOT vs ON COLUMNS(* EXCLUDE variant) INTO NAME metric VALUE value) SELECT metric, max(value) FILTER (WHERE variant = 'baseline') AS baseline, max(value) FILTER (WHERE variant = 'candidate') AS candidate, max(value) FILTER (WHERE variant = 'candidate') - max(value) FILTER (WHERE variant = 'baseline') AS change FROM u GROUP BY 1"),
    "field_profile": _evaluated(""", x AS (SELECT 'expected' AS source, k, true AS ok, true AS has FROM o UNION ALL SELECT variant, k, parse_valid, NOT no_status FROM f), y AS (
        SELECT source, unnest(CASE WHEN has THEN ['/priority', '/status', '/cents'] ELSE ['/priority', '/cents'] END) AS pointer FROM x WHERE ok)
        SELECT source, pointer, count(*) AS present, count(*) FILTER (WHERE pointer <> '/cents') AS n_string, count(*) FILTER (WHERE pointer = '/cents') AS n_integer, 0::BIGINT AS n_number, 0::BIGINT AS n_boolean, 0::BIGINT AS n_null, 0::BIGINT AS n_array, 0::BIGINT AS n_object,
        0::BIGINT AS like_integer, 0::BIGINT AS like_decimal, 0::BIGINT AS like_date, 0::BIGINT AS like_uuid, 0::BIGINT AS like_uri FROM y GROUP BY ALL"""),
    "field_inventory": _evaluated(""", p2 AS (SELECT unnest(['/priority', '/status', '/cents']) AS pointer), n AS (SELECT (SELECT count(*) FROM o) AS e, (SELECT count(*) FROM f WHERE variant = 'baseline' AND parse_valid) AS b, (SELECT count(*) FROM f WHERE variant = 'candidate' AND parse_valid) AS c, (SELECT count(*) FROM f WHERE variant = 'candidate' AND schema_valid) AS cs)
        SELECT pointer, e AS expected, b AS baseline, CASE pointer WHEN '/status' THEN cs ELSE c END AS candidate, CASE pointer WHEN '/cents' THEN 'integer' ELSE 'string' END AS type, false AS candidate_omits, CASE pointer WHEN '/cents' THEN 'exact_integer' ELSE 'normalized_string' END AS suggested FROM p2, n"""),
    "mapping_candidates": "SELECT unnest(['/event_id', '/call', '/call/event_type', '/call/props']) AS pointer",
    "value_likeness": "SELECT \"like\", count(*) AS n FROM (SELECT unnest(['integer', 'date', 'text', 'decimal', 'uri']) AS \"like\" FROM orders) GROUP BY 1",
    "json_types": "SELECT type, count(*) AS n FROM (SELECT unnest(['integer', 'string', 'object', 'array', 'boolean', NULL]) AS type FROM events) GROUP BY 1",
    "schema_inspection": "SELECT n_nationkey, t.* FROM nation, LATERAL (VALUES ('/total', 'number|null', true), ('/' || n_name, 'string', false), ('/items', 'array', false), ('/items/*/description', 'string', true), ('/items/*/amount', 'string', false)) AS t(pointer, type, required)",
    "jsonl_ingest": """WITH k AS (SELECT o_orderkey AS k FROM orders), v AS (SELECT 'blank_line' AS violation FROM k WHERE k % 500 = 0 UNION ALL SELECT 'malformed_json' FROM k WHERE k % 500 <> 0 AND k % 501 = 0 UNION ALL SELECT 'bad_id' FROM k WHERE k % 500 <> 0 AND k % 501 <> 0 AND k % 502 = 0
        UNION ALL SELECT 'duplicate_id' FROM k WHERE k % 500 <> 0 AND k % 501 <> 0 AND k % 502 <> 0 AND k % 503 = 0 AND k > 0) SELECT violation, count(*) AS n FROM v GROUP BY 1""",
    "output_violations": """WITH k AS (SELECT event_id AS k, CASE WHEN event_id % 50 = 0 THEN 'unknown_field' WHEN event_id % 51 = 0 THEN 'ok_without_output' WHEN event_id % 52 = 0 THEN 'failed_without_error' WHEN event_id % 53 = 0 THEN 'outputs_differ' WHEN event_id % 54 = 0 THEN 'bad_cost' END AS v FROM events),
        a AS (SELECT v AS violation FROM k WHERE v IS NOT NULL UNION ALL SELECT 'unknown_id' FROM k WHERE k % 40 = 0) SELECT violation, count(*) AS n FROM a GROUP BY 1""",
    "csv_ingest": "SELECT 'string' AS id_type, 'object' AS props_type, 'string' AS event_type, count(*) AS n FROM events",
    "simple_import": "SELECT CASE WHEN event_id % 4 < 2 THEN 'ok' ELSE 'error' END AS status, CASE WHEN event_id % 4 >= 2 THEN 'provider' END AS error_kind, count(*) AS n, count(*) FILTER (WHERE event_id % 4 < 2) AS outputs FROM events GROUP BY ALL",
}

#: Orders with what they give away, as the queries plant it.
_LEAKY = """
WITH o AS (
  SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
), lk AS (
  SELECT k, k % 30 = 0 OR k % 50 = 0 OR cents = k AS seen, k % 40 = 0 AS named FROM o
)
"""

#: Receipts by their planted faults, and the faults that follow.
_RECEIPTS = """
WITH r AS (
  SELECT o_orderkey AS k, unnest(['baseline', 'candidate']) AS variant FROM orders
), x AS (
  SELECT k, variant, 'mine' AS evaluator, unnest(list_filter([CASE WHEN k % 31 = 0 THEN 'missing' END, CASE WHEN k % 53 = 0 AND k % 31 <> 0 THEN 'repeated' END, CASE WHEN k % 37 = 0 AND k % 31 <> 0 THEN 'request_hash' END,
    CASE WHEN k % 41 = 0 AND k % 31 <> 0 THEN 'response_hash' END, CASE WHEN k % 47 = 0 AND k % 31 <> 0 THEN 'result' END], lambda m: m IS NOT NULL)) AS mismatch FROM r
  UNION ALL SELECT k, variant, 'old', 'unused' FROM r WHERE k % 43 = 0
)
"""

#: Lines of another shape, by their planted faults.
_FOREIGN = """
WITH e AS (
  SELECT event_id AS k, CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 101 = 0 THEN 'odd' ELSE 'ok' END AS status FROM events
), good AS (
  SELECT *, CASE WHEN status = 'missing' THEN 'missing_output' WHEN status = 'error' AND k % 4 = 1 THEN 'provider' WHEN status = 'error' THEN 'recorded_error' END AS error_kind,
    CASE WHEN status = 'error' THEN CASE k % 4 WHEN 1 THEN 'busy' WHEN 2 THEN 'gone' WHEN 3 THEN 'Recorded error: [1]' ELSE 'no error was recorded' END END AS error_message
  FROM e WHERE k % 109 <> 0 AND k % 103 <> 0 AND status <> 'odd' AND NOT (status = 'ok' AND k % 107 = 0)
)
"""

_TITLES = """SELECT s.integrity, s.blocking, CASE WHEN s.integrity = 'modified' THEN 'EVIDENCE MODIFIED' WHEN s.integrity = 'replay_failed' THEN 'REPLAY FAILED' WHEN s.integrity <> 'verified' THEN 'EVIDENCE NOT VERIFIED'
  WHEN s.blocking THEN 'PINNED REGRESSION SUITE FAILED' WHEN g.deployment_authorized THEN 'RELEASE AUTHORIZED' WHEN g.decision = 'error' THEN 'RUN ERROR' WHEN g.n_failed > 0 THEN 'DO NOT DEPLOY'
  WHEN g.decision = 'insufficient_evidence' THEN 'NOT ENOUGH EVIDENCE' ELSE 'ANALYSIS COMPLETE' END AS title
  FROM ({gate}) g, (SELECT unnest(['verified', 'modified', 'replay_failed', 'not_verified']) AS integrity) i, LATERAL (SELECT i.integrity, unnest([true, false]) AS blocking) s"""

ORACLES |= {
    "schema_warnings": "SELECT n_nationkey, '/total' AS pointer, 'nullable_union' AS warning FROM nation UNION ALL SELECT n_nationkey, '/' || n_name, 'large_enum' FROM nation WHERE n_nationkey % 3 = 0",
    "schema_errors": _evaluated("""SELECT variant, x.pointer, x.keyword, count(*) AS n FROM (SELECT variant, unnest(list_filter([CASE WHEN bad_priority THEN {'pointer': '/priority', 'keyword': 'enum'} END, CASE WHEN no_status THEN {'pointer': '/status', 'keyword': 'required'} END,
        CASE WHEN cents + bad_cents::INT > 20000000 THEN {'pointer': '/cents', 'keyword': 'maximum'} END], lambda v: v IS NOT NULL)) AS x FROM f WHERE parse_valid) GROUP BY ALL"""),
    "schema_valid_outputs": _evaluated("SELECT variant, parse_valid, parse_valid AND NOT bad_priority AND NOT no_status AND cents + bad_cents::INT <= 20000000 AS schema_valid, count(*) AS n FROM f GROUP BY ALL"),
    "configured_run": ORACLES["paired_metrics"],
    "evidence_units_by_pointer": """WITH u AS (SELECT count(*) AS rows FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL GROUP BY source) SELECT rows, count(*) AS units FROM u GROUP BY 1
        UNION ALL SELECT NULL, count(*) FROM documents WHERE doc_id % 7 = 0 OR source IS NULL""",
    "evidence_units_included": """WITH u AS (SELECT count(*) AS rows FROM documents GROUP BY text, lang), v AS (SELECT count(*) AS rows FROM documents GROUP BY lang, CASE WHEN doc_id % 7 <> 0 THEN source END)
        SELECT 'fingerprint:/input,/expected,/model_visible_metadata' AS label, rows, count(*) AS units FROM u GROUP BY 2 UNION ALL SELECT 'fingerprint:/expected,/metadata', rows, count(*) FROM v GROUP BY 2""",
    "gold_leaks": _LEAKY + "SELECT k, seen AS gold_visible, named AS id_suspicious FROM lk WHERE seen OR named",
    "doctor_checks": _LEAKY + """, c AS (SELECT lk.k, lk.k % 29 = 0 AS bad, lk.k % 60 = 7 AS same, o_orderpriority AS p, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM lk JOIN orders ON o_orderkey = lk.k),
        v AS (SELECT *, NOT same AND ((k % 30 = 0 AND NOT bad) OR (k % 50 = 0 AND (NOT bad OR s = 'O')) OR (cents = k AND NOT bad)) AS seen, k % 40 = 0 AND (NOT bad OR s = 'O') AS named FROM c)
        SELECT x.* FROM (SELECT count(*) FILTER (WHERE bad) * 2 AS refs, count(DISTINCT CASE WHEN same THEN CASE WHEN bad THEN 'bad' ELSE concat_ws('|', p, s, cents) END END) AS labels, count(*) FILTER (WHERE same) AS same, count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE named) AS named FROM v) n,
        LATERAL (VALUES ('reference_preflight', refs = 0, true, refs), ('label_conflicts', labels <= 1, true, (labels > 1)::BIGINT), ('evidence_unit_resolves', true, true, 0), ('golden_value_isolation', seen = 0, true, seen), ('suspicious_ids', named = 0, false, named),
        ('potential_evidence_collisions', true, false, greatest(same - 1, 0))) AS x("check", passed, required, cases)""",
    "mapped_import": _FOREIGN + "SELECT status, error_kind, error_message, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS outputs, sum(k % 100)::BIGINT AS latency_ms, sum(k % 10)::BIGINT AS input_tokens FROM good GROUP BY ALL",
    "mapped_import_violations": _FOREIGN + """SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 109 = 0 THEN 'malformed_json' END, CASE WHEN k % 109 <> 0 AND k % 103 = 0 THEN 'bad_id' END, CASE WHEN k % 109 <> 0 AND status = 'odd' THEN 'bad_status' END,
        CASE WHEN k % 109 <> 0 AND status = 'ok' AND k % 107 = 0 THEN 'ok_without_output' END], lambda v: v IS NOT NULL)) AS violation FROM e) GROUP BY 1""",
    "csv_typed_cells": "SELECT 'string' AS id, 'integer' AS n, 'boolean' AS yes, 'object' AS props, 'string' AS said, count(*) AS rows FROM events",
    "token_remap": "SELECT o_orderkey::VARCHAR AS case_id, o_orderkey AS said FROM orders WHERE o_orderkey % 23 <> 0",
    "structural_differences": """WITH l AS (SELECT l_orderkey AS k, l_linenumber, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2), e AS (
        SELECT unnest(CASE WHEN part % 23 = 0 THEN ['removed', 'removed'] WHEN part % 29 = 0 THEN ['unchanged', 'type_changed'] WHEN part % 17 = 0 THEN ['unchanged', 'changed'] ELSE ['unchanged', 'unchanged'] END) AS state FROM l
        UNION ALL SELECT 'added' FROM l GROUP BY k HAVING bool_and(part % 23 = 0)) SELECT state, count(*) AS n FROM e GROUP BY 1""",
    "outcome_displays": _evaluated(f"""SELECT CASE WHEN bt = 'true' AND bp THEN 'Correct' WHEN bt = 'false' AND bp THEN 'Wrong' WHEN bt = 'error' THEN 'Evaluation error' END AS baseline, CASE WHEN ct = 'true' AND cp THEN 'Correct' WHEN ct = 'false' AND cp THEN 'Wrong' WHEN ct = 'error' THEN 'Evaluation error' END AS candidate,
        CASE {_MOVED} WHEN 'both_pass' THEN 'Both pass' WHEN 'baseline_only_pass' THEN 'Regression' WHEN 'candidate_only_pass' THEN 'Improvement' ELSE 'Both fail' END AS transition, count(*) AS n FROM pr GROUP BY ALL"""),
    "first_failures": _evaluated("SELECT variant, CASE WHEN NOT parse_valid THEN NULL WHEN bad_priority THEN '/priority' WHEN no_status THEN '/status' WHEN bad_cents THEN '/cents' END AS pointer, count(*) AS n FROM f GROUP BY ALL"),
    "case_page_search": _evaluated(", h AS (SELECT pr.k FROM pr JOIN o ON o.k = pr.k WHERE b AND NOT c AND lower(priority) LIKE '%urgent%') SELECT k, 'baseline_only_pass' AS transition, (SELECT count(*) FROM h) AS total FROM h ORDER BY k LIMIT 5 OFFSET 3"),
    "case_page_pinned": _evaluated(f"SELECT k, {_MOVED} AS transition, (SELECT count(*) FROM pr WHERE k % 10 = 3) AS total FROM pr WHERE k % 10 = 3 ORDER BY k LIMIT 40"),
    "pointer_patterns": """WITH l AS (SELECT l_orderkey % 10 AS a, l_linenumber AS b FROM lineitem) SELECT x.* FROM (SELECT count(*) FILTER (WHERE b = 1) AS p, count(*) FILTER (WHERE a = 3) AS q, count(*) AS r, count(*) FILTER (WHERE a = 7 AND b = 2) AS s FROM l) n,
        LATERAL (VALUES ('/orders/*/1', p), ('/orders/3/*', q), ('/*/*/*', r), ('/orders/*', 0), ('/orders/7/2', s)) AS x(pattern, n)""",
    "truncated_texts": """WITH w AS (SELECT doc_id, replace(replace(text, 'e', 'é'), 't', '日') AS t FROM documents)
        SELECT doc_id, md5(CASE WHEN strlen(t) <= 101 THEN t ELSE left(t, list_max(list_filter(range(0, 102), lambda n: strlen(left(t, n)) <= 101))::BIGINT) || chr(10) || '[truncated]' END) AS digest FROM w""",
    "decision_title": _TITLES.format(gate=ORACLES["gate_decision"]),
    "receipt_mismatches": _RECEIPTS + "SELECT variant, evaluator, mismatch, count(*) AS n FROM x GROUP BY ALL",
    "repeated_receipts": "SELECT o_orderkey AS k, unnest(['baseline', 'candidate']) AS variant, 2::BIGINT AS n FROM orders WHERE o_orderkey % 53 = 0 AND o_orderkey % 31 <> 0",
    "replay_report": _RECEIPTS + "SELECT (SELECT count(*) FROM orders) AS replayed, (SELECT count(*) FROM orders WHERE o_orderkey % 101 = 0) AS row_mismatches, (SELECT count(*) FROM x) AS receipt_mismatches, 1::BIGINT AS artifact_mismatches, false AS verified",
}

ORACLES |= reuse.ORACLES

ORACLES["bootstrap_interval"] = EVALUATIONS + """
, m AS (SELECT custkey % 5 AS segment, count(*) AS n, count(*) FILTER (WHERE bd AND NOT cd) AS l, count(*) FILTER (WHERE NOT bd AND cd) AS w FROM pr GROUP BY 1)
SELECT segment, round(100.0::DOUBLE * (w - l) / n, 9) AS difference_pp, round(100 * sqrt((w + l) / n::DOUBLE - pow((w - l) / n::DOUBLE, 2)) / sqrt(n), 9) AS standard_error_pp, true AS lower_pp, true AS upper_pp FROM m"""
