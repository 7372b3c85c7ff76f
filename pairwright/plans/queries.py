"""Registered queries over the provided tables, one or more for each operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import stats
from pairwright.functions import text as T
from pairwright.functions.json import json_type, read_json
from pairwright.operators import evaluators as E
from pairwright.operators import evidence, gate, pairing, profile, review, summary
from pairwright.plans.paired import ORDERS, Evaluation, Rule, evaluate, evaluate_all, judged, order_cases, order_evaluations, order_outputs, order_pairs, reference_issues, table
from pairwright.plans import inspection, reuse
from pairwright.sources import records
from pairwright.sources.scratch import shared_path

QUERIES: dict = inspection.QUERIES | reuse.QUERIES


def query(f):
    QUERIES[f.__name__] = f
    return f


def _json(x):
    """A column's value as canonical JSON text."""
    return F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)


# Joins and denominators


@query
def denominator_join(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.with_outputs(order_cases(spark, d), order_outputs(spark, d, "baseline"))
    return rows.select("k", "status", "error_kind", F.col("latency_ms").cast("long").alias("latency_ms"))


@query
def unknown_output_ids(spark: SparkSession, d: str) -> DataFrame:
    cases = order_cases(spark, d).where("k % 5 <> 0")
    return pairing.unknown_outputs(cases, order_outputs(spark, d, "candidate")).groupBy("status").agg(F.count("*").alias("strangers"))


@query
def id_coverage(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("case_id"))
    return pairing.coverage(order_cases(spark, d), order_outputs(spark, d, "baseline"), line)


@query
def execution_tokens(spark: SparkSession, d: str) -> DataFrame:
    return order_cases(spark, d).select("k", pairing.execution_token("run-1", F.col("k")).alias("token"))


# Parsing, evaluators and outcomes


@query
def parse_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return order_evaluations(spark, d).groupBy("variant", "status", "parse_valid").agg(F.count("*").alias("n"))


@query
def schema_validity(spark: SparkSession, d: str) -> DataFrame:
    return order_evaluations(spark, d).groupBy("variant").agg(F.count_if("schema_valid").alias("valid"), F.count_if(F.col("parse_valid") & ~F.col("schema_valid")).alias("parsed_but_invalid"))


@query
def pointer_exact(spark: SparkSession, d: str) -> DataFrame:
    return order_evaluations(spark, d).groupBy("variant", F.col("priority_state").alias("state")).agg(F.count("*").alias("n"))


@query
def pointers_exact(spark: SparkSession, d: str) -> DataFrame:
    state = E.worst(F.col("priority_state"), F.col("status_state"), F.col("cents_state"))
    return order_evaluations(spark, d).groupBy("variant", state.alias("state")).agg(F.count("*").alias("n"))


@query
def enum_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = order_evaluations(spark, d).join(order_cases(spark, d).select(F.col("id").alias("case_id"), F.get_json_object("expected", "$.status").alias("label")), "case_id")
    return e.groupBy("variant", "label").agg(F.count_if(F.col("status_state") == "passed").alias("right"), F.count("*").alias("n"))


@query
def exact_json(spark: SparkSession, d: str) -> DataFrame:
    e = order_evaluations(spark, d).withColumn("reference", read_json(F.col("expected"), [])["canonical"])
    return e.groupBy("variant", E.parsed_only(F.col("parse_valid"), E.exact(F.col("reference"), F.col("output"))).alias("state")).agg(F.count("*").alias("n"))


@query
def tool_selection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    call = F.to_json(F.struct(F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.col("event_type")).alias("name")))
    found = e.select("event_type", read_json(call, ["/name"])["found"].alias("f"))
    return found.groupBy("event_type", E.exact(_json(F.col("event_type")), F.get("f", F.lit(0))).alias("state")).agg(F.count("*").alias("n"))


@query
def tool_arguments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("r", read_json(F.col("props"), ["/k", "/unit"]))
    other = F.when(F.col("event_id") % 6 == 0, F.lit(None).cast("string")).otherwise(F.get("r.found", F.lit(0)))
    state = E.worst(E.exact(F.get("r.found", F.lit(0)), other), F.when(F.col("event_id") % 4 == 0, E.exact(F.get("r.found", F.lit(1)), F.lit('"x"'))).otherwise("not_applicable"))
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query
def normalized_string(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    # Every fourth name in full-width letters and with an accent apart, which only NFKC makes equal to the plain form.
    p = p.withColumn("plain", F.upper("p_name"))
    wide = F.translate("plain", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    p = p.withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" caf\u00e9"))).otherwise(F.col("p_name")))
    noisy = F.when(F.col("p_partkey") % 4 == 0, F.concat(wide, F.lit(" CAFE\u0301"))).otherwise(F.col("plain"))
    noisy = F.concat(F.lit("  "), noisy, F.when(F.col("p_partkey") % 9 == 0, " x").otherwise("\t "))
    return p.groupBy(E.normalized_string(_json(F.col("p_name")), _json(noisy)).alias("state"), E.normalized_string(_json(F.col("p_name")), _json(noisy), case_insensitive=False).alias("state_with_case")).agg(F.count("*").alias("n"))


@query
def canonical_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 10 == 0, "2023-02-30").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format(F.date_add("o_orderdate", (F.col("o_orderkey") % 7 == 0).cast("int")), "yyyy-M-d"))
    return o.groupBy(E.canonical_date(_json(iso), _json(said), ("iso", "dmy_slash")).alias("state")).agg(F.count("*").alias("n"))


@query
def numeric_absolute(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("p", F.round("l_extendedprice", 2).cast("decimal(18,2)"))
    off = (F.col("p") + (F.col("l_linenumber") - 1).cast("decimal(9,2)") * F.lit("0.01").cast("decimal(9,2)")).cast("string")
    # Every third amount in cents with an exponent, every seventh with more places than are exact.
    off = F.when(F.col("l_partkey") % 7 == 0, F.concat(off, F.lit("00000000000001"))).when(F.col("l_partkey") % 3 == 0, F.concat(F.regexp_replace(off, r"\.", ""), F.lit("e-4"))).otherwise(off)
    return li.groupBy("l_linenumber", E.numeric_tolerance(F.col("p").cast("string"), _json(off), absolute="0.02").alias("state")).agg(F.count("*").alias("n"))


@query
def numeric_relative(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("p", F.round("l_extendedprice", 2).cast("decimal(18,2)"))
    off = (F.col("p") * (F.lit(1) + F.col("l_linenumber").cast("decimal(4,0)") * F.lit("0.001").cast("decimal(9,4)"))).cast("decimal(18,6)").cast("string")
    return li.groupBy("l_linenumber", E.numeric_tolerance(F.col("p").cast("string"), off, relative="0.0035").alias("state")).agg(F.count("*").alias("n"))


@query
def exact_integer(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    said = F.when(k % 5 == 0, F.concat(F.lit(" 000"), k.cast("string"))).when(k % 7 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 11 == 0, (k + 1).cast("string")).otherwise(k.cast("string"))
    return p.groupBy(E.exact_integer(k.cast("string"), _json(said)).alias("state")).agg(F.count("*").alias("n"))


@query
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("r", read_json(F.when(F.col("event_id") % 8 == 0, '{"k":null}').when(F.col("event_id") % 9 == 0, "{}").otherwise(F.col("props")), ["/k"]))
    return e.groupBy("event_type", E.required_fields(F.get("r.found", F.lit(0))).alias("state")).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as the reference's and the output's array."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(12,2)").alias("q"), F.col("l_partkey").alias("part"))
    item = lambda q: F.struct(F.col("l_linenumber").alias("line"), q.alias("q"), F.col("part").alias("part"))
    wrong = F.when(F.col("part") % 17 == 0, F.col("q") + 1).otherwise(F.col("q")).cast("decimal(12,2)")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item(F.col("q")))).alias("expected"), F.collect_list(F.when(F.col("part") % 23 != 0, item(wrong))).alias("actual"))


@query
def keyed_array_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select(E.keyed_array(F.col("expected"), F.col("actual"), "line", {"q": "0.50", "part": "exact"}).alias("r"))
    return rows.groupBy("r.status").agg(F.count("*").alias("orders"), F.coalesce(F.sum(F.size("r.missing")), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.sum("r.mismatched"), F.lit(0)).cast("long").alias("mismatched"))


@query
def keyed_array_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """References against themselves: all pass but those whose keys repeat, which are errors."""
    rows = _lines(spark, d).select("expected", E.keyed_array(F.col("expected"), F.col("expected"), "line", {"q": "0.00", "part": "exact"}).alias("r"))
    repeated = F.size("expected") - F.size(F.array_distinct(F.transform("expected", lambda i: i["line"])))
    return rows.groupBy("r.status").agg(F.count("*").alias("orders"), F.sum(repeated).cast("long").alias("repeats"))


#: Documents of orders' lines, compared by a plan: arrays by key, sums, required fields, and the whole.
LINES = Evaluation((
    Rule("items", "keyed_array", ("/items",), options={"keys": {"/line": "exact"}, "fields": {"/q": ("decimal", {"absolute": "0.50"}), "/part": ("exact_integer", {})}}),
    Rule("sums", "financial_invariants", ("/items", "/subtotal", "/tax", "/total"), options={"line": ("/quantity", "/unit_price", "/amount")}),
    Rule("needed", "required_fields", ("/items/0", "/total")), Rule("head", "tool_arguments", ("/order", "/kind")),
), primary=("items", "sums"))


def _line_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases and outputs: lines left out, changed, with texts for amounts, and totals that are off."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("decimal(12,2)").alias("q"))
    price = F.lit("2.50").cast("decimal(18,2)")
    amount = (F.col("q") * price + F.when(F.col("part") % 41 == 0, 1).otherwise(0)).cast("decimal(18,4)")
    said = F.when(F.col("part") % 37 == 0, "n/a").otherwise(amount.cast("string"))
    item = F.struct("line", "part", F.when(F.col("part") % 17 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"), F.col("q").alias("quantity"), price.alias("unit_price"), said.alias("amount"))
    by = li.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("line", "part", "q"))).alias("e"), F.collect_list(F.when(F.col("part") % 23 != 0, item)).alias("a"),
        F.coalesce(F.sum(F.when((F.col("part") % 23 != 0) & (F.col("part") % 37 != 0), amount)), F.lit(0)).cast("decimal(30,4)").alias("sum"),
    )
    off = F.when(F.col("k") % 10 == 0, 2).otherwise(1)
    cases = by.select(F.col("k").cast("string").alias("id"), "k", F.to_json(F.struct(F.col("k").alias("order"), F.lit("lines").alias("kind"), F.col("e").alias("items"))).alias("expected"))
    doc = F.to_json(F.struct(F.col("k").alias("order"), F.when(F.col("k") % 9 != 0, "lines").alias("kind"), F.col("a").alias("items"), F.col("sum").alias("subtotal"), F.lit("1.00").alias("tax"), (F.col("sum") + off).cast("decimal(30,4)").alias("total")))
    return cases, by.select(F.col("k").cast("string").alias("case_id"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_kind"), doc.alias("raw_output"))


@query
def plan_line_documents(spark: SparkSession, d: str) -> DataFrame:
    """A plan over nested documents: keyed arrays, financial checks, required fields and pointer lists."""
    cases, outputs = _line_documents(spark, d)
    return evaluate(cases, outputs, "candidate", LINES).select("k", "items_state", "sums_state", "needed_state", "head_state", "truth", "fully_evaluated")


@query
def financial_invariants(spark: SparkSession, d: str) -> DataFrame:
    dec = "decimal(18,2)"
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).cast(dec).alias("unit_price"), "l_partkey")
    amount = F.when(F.col("l_partkey") % 37 == 0, F.lit(None).cast("decimal(31,4)")).when(F.col("l_partkey") % 41 == 0, F.col("quantity") * F.col("unit_price") + 1).otherwise(F.col("quantity") * F.col("unit_price")).cast("decimal(31,4)")
    rows = li.withColumn("amount", amount).groupBy("l_orderkey").agg(F.collect_list(F.struct("quantity", "unit_price", "amount")).alias("items"), F.sum("amount").cast("decimal(38,4)").alias("subtotal"))
    tax = F.lit("1.00").cast("decimal(38,4)")
    total = F.col("subtotal") + F.when(F.col("l_orderkey") % 10 == 0, F.lit(2)).otherwise(F.lit(1)).cast("decimal(38,4)")
    return rows.groupBy(E.financial_invariants(F.col("items"), F.col("subtotal"), tax, total).alias("status")).agg(F.count("*").alias("orders"))


@query
def reference_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluator of a plan is held against the reference itself; what isn't passed is an issue."""
    cases = order_cases(spark, d).withColumn("expected", F.when(F.col("k") % 29 == 0, '{"priority":7,"status":"O"}').otherwise(F.col("expected")))
    plan = Evaluation((("priority", "/priority", "normalized_string"), ("status", "/status", "exact"), ("cents", "/cents", "exact_integer")))
    return reference_issues(cases, plan).select(F.col("id").cast("long").alias("k"), "evaluator", "state")


@query
def outcome_all_of(spark: SparkSession, d: str) -> DataFrame:
    return order_evaluations(spark, d).groupBy("variant", "truth", "fully_evaluated").agg(F.count("*").alias("n"))


@query
def outcome_any_of(spark: SparkSession, d: str) -> DataFrame:
    return order_evaluations(spark, d).groupBy("variant", F.col("any_truth").alias("truth")).agg(F.count("*").alias("n"))


@query
def case_evaluation_flags(spark: SparkSession, d: str) -> DataFrame:
    return order_evaluations(spark, d).select("k", "variant", "structured_success", "semantic_success", "deployment_success", "valid_but_wrong", "fully_evaluated_valid_but_wrong")


@query
def external_evaluator(spark: SparkSession, d: str) -> DataFrame:
    """A user's Python evaluator over whole batches of both variants, named by a plan; some of its results are lost, some unheard of."""

    def score(batch: pd.DataFrame) -> pd.Series:
        k = batch["key"].str.split(":").str[1].astype("int64")
        return batch["raw_output"].isna().map({True: "not_applicable", False: "passed"}).where(k % 31 != 0, "unheard of")

    outputs = {v: order_outputs(spark, d, v) for v in ("baseline", "candidate")}
    rows = outputs["baseline"].withColumn("variant", F.lit("baseline")).union(outputs["candidate"].withColumn("variant", F.lit("candidate")))
    found = E.external(rows.select(F.concat_ws(":", "variant", "case_id").alias("key"), "raw_output"), "mine", score, id_col="key")
    name = F.split("key", ":")
    found = found.select(name[0].alias("variant"), name[1].alias("case_id"), "evaluator", "status").where("case_id % 5 <> 0")
    plan = Evaluation((Rule("mine", "external"), ("priority", "/priority", "exact")))
    return evaluate_all(order_cases(spark, d), outputs, plan, found).groupBy("variant", F.col("mine_state").alias("status"), "truth").agg(F.count("*").alias("n"))


# Pairs and statistics


@query
def transitions(spark: SparkSession, d: str) -> DataFrame:
    p = order_pairs(spark, d)
    return p.groupBy(pairing.transition(F.col("baseline.semantic_success"), F.col("candidate.semantic_success")).alias("transition")).agg(F.count("*").alias("n"))


@query
def semantic_transitions(spark: SparkSession, d: str) -> DataFrame:
    p = order_pairs(spark, d)
    moved = F.when(F.col("baseline.fully_evaluated") & F.col("candidate.fully_evaluated"), pairing.transition(F.col("baseline.semantic_success"), F.col("candidate.semantic_success")))
    return p.groupBy(moved.alias("transition")).agg(F.count("*").alias("n"))


@query
def paired_metrics(spark: SparkSession, d: str) -> DataFrame:
    return summary.paired_metrics(order_pairs(spark, d), "semantic_success")


@query
def deployment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return summary.paired_metrics(order_pairs(spark, d), "deployment_success")


@query
def paired_by_segment(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    p = order_pairs(spark, d).withColumn("custkey", F.col("baseline.custkey")).join(seg, "custkey")
    return summary.paired_metrics(p, "semantic_success", ["segment"])


@query
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """The p value of every customer's orders, and of all of them together."""
    p = order_pairs(spark, d).select(F.col("baseline.custkey").alias("custkey"), F.col("baseline.semantic_success").alias("b"), F.col("candidate.semantic_success").alias("c"))
    counts = p.rollup("custkey").agg(F.count_if(F.expr("b and not c")).alias("losses"), F.count_if(F.expr("c and not b")).alias("wins"))
    return counts.select("custkey", "losses", "wins", F.round(stats.mcnemar(F.col("losses"), F.col("wins")) + 1e-12, 9).alias("p"))


@query
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of the deployment effect by customer segment, and whether their ends lie within half a standard error of those that many samples tend to."""
    p = order_pairs(spark, d).withColumn("segment", F.col("baseline.custkey") % 5)
    m = p.groupBy("segment").agg(*stats.paired_counts(F.col("baseline.deployment_success"), F.col("candidate.deployment_success")))
    m = m.withColumn("i", stats.interval(tuple(map(F.col, ("both_pass", "baseline_only", "candidate_only", "both_fail"))), 4000, 0.95, 7))
    wins, losses, n = F.col("candidate_only"), F.col("baseline_only"), F.col("total")
    error = 100 * F.sqrt((wins + losses) / n - F.pow((wins - losses) / n, 2)) / F.sqrt(n)
    near = lambda end, side: (F.abs(F.col(f"i.{end}") - (F.col("difference_pp") + side * 1.959963985 * error)) <= error / 2).alias(end)
    return m.select("segment", "difference_pp", F.round(error, 9).alias("standard_error_pp"), near("lower_pp", -1), near("upper_pp", 1))


@query
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.variant_summary(order_evaluations(spark, d))


@query
def operational_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.operational_summary(order_evaluations(spark, d))


@query
def matched_operational(spark: SparkSession, d: str) -> DataFrame:
    return summary.matched_operational(order_pairs(spark, d))


@query
def cost_by_currency(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.when((F.col("variant") == "candidate") & (F.col("k") % 2 == 0), "EUR").otherwise(F.col("currency"))
    return summary.cost_summary(order_evaluations(spark, d).withColumn("currency", mixed))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    e = order_evaluations(spark, d)
    facts = F.array(*(F.struct(F.lit(n).alias("evaluator"), F.lit(f"/{n}").alias("pointer"), F.col(f"{n}_state").alias("state")) for n in ("priority", "status", "cents")))
    return e.select("case_id", "k", "variant", F.explode(facts).alias("f")).select("case_id", "k", "variant", "f.*").withColumn("state", F.when((F.col("evaluator") == "cents") & (F.col("k") % 43 == 0), F.lit(None)).otherwise(F.col("state")))


@query
def evaluator_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.evaluator_states(_facts(spark, d))


@query
def field_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return summary.field_hotspots(summary.field_states(_facts(spark, d)))


@query
def hotspot_rollup(spark: SparkSession, d: str) -> DataFrame:
    return summary.field_hotspots(summary.field_states(_facts(spark, d))).groupBy("pointer").agg(F.sum("regressions").cast("long").alias("regressions"), F.sum("improvements").cast("long").alias("improvements")).orderBy(F.desc("regressions"), "pointer")


@query
def semantic_effect_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return summary.semantic_exclusions(order_pairs(spark, d))


@query
def study_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Studies, a market segment each, given as counts, expanded to cases and summed again, never pooled."""
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("id"))
    p = order_pairs(spark, d).withColumn("custkey", F.col("baseline.custkey")).join(seg, "custkey")
    cell = pairing.transition(F.col("baseline.semantic_success"), F.col("candidate.semantic_success"))
    counts = p.groupBy("id").agg(*(F.count_if(cell == name).cast("int").alias(name) for name in pairing.TRANSITIONS))
    rows = records.expanded(counts)
    return rows.groupBy("id").agg(*stats.paired_counts(F.col("baseline"), F.col("candidate"))).withColumn("mcnemar_p", F.round(stats.mcnemar(F.col("baseline_only"), F.col("candidate_only")), 9))


# Evidence


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("stimulus", evidence.digest(F.col("text"))).withColumn("seen", evidence.digest(F.col("lang"), F.col("source")))


@query
def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    return evidence.units(_documents(spark, d), F.col("stimulus"), F.col("seen")).groupBy("kind").agg(F.count("*").alias("units"), F.sum("rows").cast("long").alias("rows"))


@query
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evidence.unit_summary(evidence.units(_documents(spark, d), F.col("stimulus"), F.col("seen")))
    return s.select(*(F.col(c).cast("long").alias(c) if c != "duplicate_row_rate" else F.col(c) for c in s.columns))


@query
def independent_population(spark: SparkSession, d: str) -> DataFrame:
    return evidence.independent(_documents(spark, d), F.col("stimulus"), F.col("seen"), "doc_id").select("doc_id", "lang", "source")


@query
def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return evidence.label_conflicts(rows, F.col("stimulus"), F.col("quality")).select(F.col("references").alias("n_references"), F.col("rows").alias("n_rows"))


@query
def evidence_collisions(spark: SparkSession, d: str) -> DataFrame:
    c = evidence.collisions(table(spark, d, "events").withColumn("s", evidence.digest(F.col("event_type"), F.col("props"))), F.col("s"))
    return c.select(*(F.col(x).cast("long").alias(x) for x in c.columns))


# The gate

LIMITS = {
    "min_cases": 1000.0, "min_unique_cases": 1000.0, "max_duplicate_case_rate": 0.1, "min_primary_fully_evaluated_rate": 0.9, "max_primary_component_error_rate": 0.05, "max_primary_component_not_applicable_rate": 0.0,
    "max_primary_component_unscored_rate": 0.0, "max_primary_regression_pp": 1.0, "max_valid_but_wrong_increase_pp": 0.5, "min_candidate_primary_success_rate": 0.5, "min_candidate_parse_validity": 0.99,
    "min_discordant_pairs": 10.0, "max_error_rate": 0.02, "max_timeout_rate": 0.01, "min_matched_latency_coverage": 1.0, "max_p95_latency_increase_percent": 10.0, "max_average_cost_increase_percent": 5.0,
}


#: What was observed of a case, by variant: verdicts, the output, and what it took.
OBSERVED = ("status", "error_kind", "parse_valid", "schema_valid", "components", "truth", "output", "latency_ms", "input_tokens", "output_tokens", "retries", "cost", "currency")


def _gate_inputs(evaluations: DataFrame, samples: int | None = None) -> DataFrame:
    """Inputs from evaluations of cases ``k``, whose key is their stimulus."""
    # Hashed before pairing, so that texts aren't shuffled.
    seen = evidence.hashed(F.to_json(F.struct(*OBSERVED)))
    p = pairing.paired(evaluations.withColumns({"reference": evidence.hashed(F.col("expected")), "seen": seen}))
    both = F.concat(*(F.coalesce(F.hex(f"{s}.seen"), F.lit("n")) for s in ("baseline", "candidate")))
    return gate.inputs(p, stimulus=F.col("baseline.k"), reference=F.hex("baseline.reference"), observation=both, samples=samples, seed=7)


@query
def gate_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _gate_inputs(order_evaluations(spark, d))


@query
def gate_rules(spark: SparkSession, d: str) -> DataFrame:
    return gate.rules(_gate_inputs(order_evaluations(spark, d)), LIMITS).select("place", "rule", "observed", "limit", "status")


@query
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    return gate.decision(gate.rules(_gate_inputs(order_evaluations(spark, d)), LIMITS), release=True)


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    """Orders' evaluations with copied rows, repeated trials, conflicting labels, and components without a state."""
    k, row = F.col("k"), F.col("_row")
    more = F.when(k % 50 == 3, "copy").when(k % 70 == 4, "again").when(k % 90 == 5, "label")
    e = order_evaluations(spark, d).withColumn("_row", F.explode(F.array_compact(F.array(F.lit(""), more)))).withColumn("case_id", F.concat("case_id", row))
    e = e.withColumns({
        "latency_ms": F.col("latency_ms") + F.when((row == "again") & (F.col("variant") == "candidate"), 1).otherwise(0),
        "expected": F.when(row == "label", "{}").otherwise(F.col("expected")),
        "cents_state": F.when(k % F.when(F.col("variant") == "baseline", 41).otherwise(8) != 0, F.col("cents_state")),
    }).drop("_row")
    return judged(e, ORDERS)


FAULTY_LIMITS = LIMITS | {"max_upper_confidence_bound_regression_pp": 5.0, "max_upper_confidence_bound_deployment_regression_pp": 5.0}


@query
def gate_inputs_faulty(spark: SparkSession, d: str) -> DataFrame:
    """All inputs but the bootstrap's bounds, which SQL can't draw."""
    return _gate_inputs(_faulty(spark, d)).drop("primary_regression_bound_pp", "deployment_regression_bound_pp")


@query
def gate_rules_faulty(spark: SparkSession, d: str) -> DataFrame:
    return gate.rules(_gate_inputs(_faulty(spark, d), samples=2000), FAULTY_LIMITS).select("place", "rule", "limit", "status")


# Review of a run


@query
def case_filters(spark: SparkSession, d: str) -> DataFrame:
    return review.filters(order_pairs(spark, d)).select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("cases"))


@query
def case_page(spark: SparkSession, d: str) -> DataFrame:
    """The page is the feature: 50 regressions, from the twentieth on."""
    hits = review.filters(order_pairs(spark, d)).where(F.array_contains("filters", "regressions")).select(F.col("baseline.k").alias("k"), "transition")
    return review.page(hits, "k", 50, 20)


@query
def case_search(spark: SparkSession, d: str) -> DataFrame:
    return review.search(order_cases(spark, d), F.col("expected"), "1-Urgent").select("k")


@query
def discordances(spark: SparkSession, d: str) -> DataFrame:
    return review.discordant(order_pairs(spark, d)).select(F.col("baseline.k").alias("k"), F.col("baseline.truth").alias("baseline_truth"), F.col("candidate.truth").alias("candidate_truth"))


@query
def report_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Keys of orders count from 0 without gaps, so they are the ordinals."""
    return review.chunks(order_cases(spark, d), F.col("k")).groupBy("chunk").agg(F.count("*").alias("cases"), F.min("place").alias("first"), F.max("place").alias("last"))


@query
def leakage_scan(spark: SparkSession, d: str) -> DataFrame:
    """Reference leaves among the leaves that an evaluated system sees."""
    e = table(spark, d, "events")
    seen = F.array(F.col("event_type"), F.get_json_object("props", "$.k"), F.lit("x"))
    gold = F.array((F.col("event_id") % 100).cast("string"))
    return review.leaks(e, seen, gold).groupBy("event_type").agg(F.count("*").alias("leaks"))


@query
def suspicious_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    named = F.concat(F.lit("case-"), F.when(F.col("event_id") % 4 == 0, F.upper("event_type")).otherwise(F.concat("event_type", F.lit("s"))), F.lit("-"), F.col("event_id").cast("string"))
    return e.groupBy("event_type").agg(F.count_if(review.suspicious_id(named, F.col("event_type"))).alias("suspicious"), F.count("*").alias("n"))


@query
def json_diff(spark: SparkSession, d: str) -> DataFrame:
    p = order_pairs(spark, d).select(F.col("baseline.k").alias("k"), F.col("baseline.output").alias("b"), F.col("candidate.output").alias("c")).where("b is not null and c is not null")
    return review.differences(p, "b", "c", "k").groupBy("path", "kind").agg(F.count("*").alias("n"))


@query
def redaction(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(review.redacted(F.col("text"), F.col("role")).cast("binary")).alias("digest"), F.md5(review.redacted(F.col("role"), F.col("role")).cast("binary")).alias("whole"))


@query
def log_sanitizer(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    log = F.concat(F.lit("start "), F.col("event_type"), F.lit("\n"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Authorization: "), "props")).otherwise(F.col("props")), F.lit("\nend"))
    return e.select("event_id", T.sanitized(log).alias("log"))


@query
def log_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("run_id", F.col("user_id"))
    return review.within_budget(e, "event_id", F.octet_length("props").cast("long"), 500).groupBy("run_id").agg(F.sum("kept_bytes").cast("long").alias("kept_bytes"), F.count_if(F.col("remaining") == 0).alias("left_out"))


@query
def replay_diff(spark: SparkSession, d: str) -> DataFrame:
    stored = order_evaluations(spark, d).where("variant = 'baseline'").select("k", "truth", "parse_valid")
    again = stored.where("k % 101 <> 0").withColumn("truth", F.when(F.col("k") % 71 == 0, "error").otherwise(F.col("truth")))
    return review.replayed(stored, again, "k", ["truth", "parse_valid"])


@query
def pin_status(spark: SparkSession, d: str) -> DataFrame:
    p = order_pairs(spark, d).select(F.col("baseline.k").alias("k"), F.col("candidate.semantic_success").alias("now"), F.col("baseline.semantic_success").alias("origin"))
    before = F.when(F.col("k") % 2 == 0, "fixed").otherwise("still_broken")
    return p.select("k", review.pin_status(F.when(F.col("k") % 15 != 0, F.col("now")), F.col("origin"), before).alias("suite_status"))


@query
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.suite_summary(pin_status(spark, d))


@query
def pin_history(spark: SparkSession, d: str) -> DataFrame:
    """A pin's runs are an order's lines: each line a run that passes or fails."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pin_id"), F.col("l_linenumber").alias("run_id")).agg((F.max("l_partkey") % 2 == 0).alias("passes"))
    return review.pin_history(li.withColumn("origin_passed", F.col("pin_id") % 2 == 0)).select("pin_id", "run_id", "suite_status")


@query
def run_selector(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run_id"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"))
    return review.latest_runs(runs)


@query
def cost_pricing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.sum(review.priced(F.col("n_chars"), (F.col("n_chars") / 4).cast("long"), "3.000000", "15.000000")).cast("double").alias("cost")).select("lang", F.round("cost", 6).alias("cost"))


@query
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counters of both variants side by side, one row per metric."""
    s = summary.variant_summary(order_evaluations(spark, d))
    metrics = [c for c in s.columns if c != "variant"]
    long = s.unpivot("variant", metrics, "metric", "value")
    side = lambda v: F.max(F.when(F.col("variant") == v, F.col("value"))).alias(v)
    return long.groupBy("metric").agg(side("baseline"), side("candidate")).withColumn("change", F.col("candidate") - F.col("baseline"))


# Profiles


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of references and of both variants' outputs, each text parsed once and none paired."""
    out = lambda v: order_outputs(spark, d, v).where("status = 'ok'")
    return profile.observed(order_cases(spark, d), "expected", "expected").union(profile.observed(out("baseline"), "baseline", "raw_output")).union(profile.observed(out("candidate"), "candidate", "raw_output"))


@query
def field_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.field_profile(_fields(spark, d))


@query
def field_inventory(spark: SparkSession, d: str) -> DataFrame:
    return profile.inventory(profile.field_profile(_fields(spark, d)))


@query
def mapping_candidates(spark: SparkSession, d: str) -> DataFrame:
    return profile.mapping_candidates(profile.observed(table(spark, d, "events").withColumn("r", F.to_json(F.struct("event_id", F.struct("event_type", "props").alias("call")))), "events", "r"))


@query
def value_likeness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    texts = F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".50")), F.concat(F.lit("http://x/"), F.col("o_orderkey").cast("string")))
    return o.select(F.explode(texts).alias("t")).groupBy(T.like_kind(F.col("t")).alias("like")).agg(F.count("*").alias("n"))


@query
def json_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("r", read_json(F.to_json(F.struct("event_id", "event_type", F.from_json("props", "map<string,int>").alias("p"), F.array("event_id").alias("a"), "value", (F.col("event_id") > 5).alias("flag"))), ["/event_id", "/event_type", "/p", "/a", "/flag", "/none"]))
    return e.select(F.explode("r.found").alias("f")).groupBy(json_type(F.col("f")).alias("type")).agg(F.count("*").alias("n"))


def _schemas(spark: SparkSession, d: str) -> DataFrame:
    """A schema for each nation: a field of its name, a reference, and for every third a wide enumeration."""
    part = '{"type":"object","required":["description"],"properties":{"description":{"type":"string"},"amount":{"type":"string","pattern":"^[0-9]+$"}}}'
    wide = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(',"enum":'), F.to_json(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i.cast("string"))))).otherwise("")
    head = F.concat(F.lit('{"type":"object","required":["total"],"properties":{"total":{"type":["number","null"]},'), F.to_json(F.array("n_name")).substr(F.lit(2), F.length("n_name") + 2), F.lit(':{"type":"string"'), wide, F.lit("},"))
    text = F.concat(head, F.lit('"items":{"type":"array","items":{"$ref":"#/$defs/part"}}},"$defs":{"part":' + part + "}}"))
    return table(spark, d, "nation").select("n_nationkey", profile.inspected(text).alias("s"))


@query
def schema_inspection(spark: SparkSession, d: str) -> DataFrame:
    return _schemas(spark, d).select("n_nationkey", F.explode("s.fields").alias("f")).select("n_nationkey", "f.*")


@query
def schema_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _schemas(spark, d).select("n_nationkey", F.explode("s.warnings").alias("w")).select("n_nationkey", "w.*")


# Sources


@query
def jsonl_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Cases written as JSON lines and read back through the strict scan, with planted faults."""
    o = order_cases(spark, d)
    line = F.to_json(F.struct("id", F.struct("k").alias("input"), F.from_json("expected", "priority string, status string, cents long").alias("expected")))
    line = F.when(F.col("k") % 500 == 0, "").when(F.col("k") % 501 == 0, "{bad").when(F.col("k") % 502 == 0, '{"id":" ","input":1}').when(F.col("k") % 503 == 0, '{"id":"1","input":1}').otherwise(line)
    path = shared_path(spark, "cases")
    o.select(line.alias("value")).write.text(path)
    _, violations = records.cases(records.json_lines(spark, path))
    return violations.groupBy("violation").agg(F.count("*").alias("n"))


@query
def output_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    line = (
        F.when(k % 50 == 0, F.concat(F.lit('{"case_id":"'), k, F.lit('","raw_output":"1","extra":2}'))).when(k % 51 == 0, F.concat(F.lit('{"case_id":"'), k, F.lit('"}')))
        .when(k % 52 == 0, F.concat(F.lit('{"case_id":"'), k, F.lit('","status":"error"}'))).when(k % 53 == 0, F.concat(F.lit('{"case_id":"'), k, F.lit('","raw_output":"{\\"a\\":1}","parsed_output":{"a":1.0}}')))
        .when(k % 54 == 0, F.concat(F.lit('{"case_id":"'), k, F.lit('","raw_output":"1","cost":{"amount":"-1","currency":"USD"}}'))).otherwise(F.concat(F.lit('{"case_id":"'), k, F.lit('","raw_output":"1"}')))
    )
    lines = e.select(k.alias("source_line"), line.alias("line"))
    _, violations = records.outputs(lines, e.where("event_id % 40 <> 0").select(k.cast("string").alias("id")))
    return violations.groupBy("violation").agg(F.count("*").alias("n"))


@query
def csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    path = shared_path(spark, "csv")
    e.select(F.lpad(F.col("event_id").cast("string"), 8, "0").alias("id"), "props", "event_type").write.option("header", True).option("escape", '"').csv(path)
    rows = records.csv_cells(spark, path)
    return rows.groupBy(json_type(F.col("id")).alias("id_type"), json_type(F.col("props")).alias("props_type"), json_type(F.col("event_type")).alias("event_type")).agg(F.count("*").alias("n"))


@query
def simple_import(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("state", F.element_at(F.array(*map(F.lit, ("ok", "SUCCESS", "failed", "odd"))), (F.col("event_id") % 4 + 1).cast("int")))
    return records.simple_outputs(e, "event_id", "props", "state").groupBy("status", "error_kind").agg(F.count("*").alias("n"), F.count("raw_output").alias("outputs"))
