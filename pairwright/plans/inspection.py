"""Registered queries that look into data before a run and into its cases after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.json import structural_diff
from pairwright.functions.text import truncated
from pairwright.operators import evidence, gate, outcomes, pairing, receipts, review
from pairwright.plans import config, preflight
from pairwright.plans.paired import ORDERS, Evaluation, evaluate_all, first_failure, order_cases, order_evaluations, order_outputs, order_pairs, table
from pairwright.sources import records
from pairwright.sources.scratch import shared_path

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Schemas and configuration

#: What an order's output has to look like.
SCHEMA = """{"type": "object", "required": ["priority", "status", "cents"], "additionalProperties": false, "properties": {
  "priority": {"enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, "status": {"type": "string", "pattern": "^[FOP]$"},
  "cents": {"allOf": [{"$ref": "#/$defs/amount"}, {"maximum": 20000000}]}}, "$defs": {"amount": {"type": "integer", "minimum": 0}}}"""
PLANNED = Evaluation(ORDERS.evaluators, schema=SCHEMA)


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return evaluate_all(order_cases(spark, d), {v: order_outputs(spark, d, v) for v in ("baseline", "candidate")}, PLANNED)


@query
def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of every output that parses, by place and keyword."""
    found = _planned(spark, d).select("variant", F.explode("schema_errors").alias("e"))
    return found.groupBy("variant", "e.pointer", "e.keyword").agg(F.count("*").alias("n"))


@query
def schema_valid_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).groupBy("variant", "parse_valid", "schema_valid").agg(F.count("*").alias("n"))


#: A whole run's configuration.
CONFIG = """{"version": 1, "evaluators": [{"id": "priority", "kind": "exact", "pointers": ["/priority"]}, {"id": "status", "kind": "exact", "pointers": ["/status"]},
  {"id": "cents", "kind": "exact_integer", "pointers": ["/cents"]}], "types": {"/priority": "string", "/status": "string", "/cents": "integer"},
  "evidence_unit": {"pointer": "/input/k"}, "gate": {"limits": {"min_cases": 1000, "max_error_rate": 0.02}}, "bootstrap": {"samples": 1000, "seed": 7}}"""


@query
def configured_run(spark: SparkSession, d: str) -> DataFrame:
    """Paired metrics of a run whose plan, units and gate come from a configuration."""
    cases = order_cases(spark, d).withColumn("input", F.to_json(F.struct("k")))
    made = config.run(cases, order_outputs(spark, d, "baseline"), order_outputs(spark, d, "candidate"), config.loaded(CONFIG))
    return made["primary"]


# Evidence and preflight


def _document_cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as cases; every seventh has no source in its metadata."""
    source = F.when(F.col("doc_id") % 7 != 0, F.col("source"))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct("text")).alias("input"), F.to_json(F.struct("lang")).alias("expected"), F.to_json(F.struct(source.alias("source"))).alias("metadata"),
    )


@query
def evidence_units_by_pointer(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of units that a pointer names; cases in which it leads nowhere have none."""
    known, lost = evidence.with_units(_document_cases(spark, d), pointer="/metadata/source")
    sizes = known.groupBy("unit").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("units"))
    return sizes.union(lost.agg(F.lit(None).cast("long"), F.count("*")))


@query
def evidence_units_included(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of units by the usual parts, and by a list of parts."""
    cases, out = _document_cases(spark, d), None
    for include in (evidence.INCLUDE, ("/expected", "/metadata")):
        known, _ = evidence.with_units(cases, include=include)
        sizes = known.groupBy("unit").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("units")).select(F.lit(evidence.unit_label(include=include)).alias("label"), "rows", "units")
        out = sizes if out is None else out.union(sizes)
    return out


def _leaky_cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases, some of whose gold values are seen or named."""
    k, at = F.col("k"), lambda n: F.get_json_object("expected", f"$.{n}")
    seen = F.to_json(F.struct(k, F.struct(F.array(F.lit("note"), F.when(k % 30 == 0, at("priority")).otherwise("none")).alias("tags")).alias("deep")))
    named = F.concat(F.lit("case-"), F.when(k % 40 == 0, F.lower(at("status"))).otherwise("x"), F.lit("-"), k.cast("string"))
    return order_cases(spark, d).withColumns({"input": seen, "model_visible_metadata": F.to_json(F.struct(F.when(k % 50 == 0, at("status")).alias("state"))), "id": named})


@query
def gold_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of references anywhere in what an evaluated system sees, and in ids."""
    return preflight.leaks(_leaky_cases(spark, d)).where("gold_visible or id_suspicious").select("k", "gold_visible", "id_suspicious")


@query
def doctor_checks(spark: SparkSession, d: str) -> DataFrame:
    """All checks of cases with leaks, bad references, colliding evidence and conflicting labels."""
    cases = _leaky_cases(spark, d)
    cases = cases.withColumns({
        "input": F.when(F.col("k") % 60 == 7, '{"same":true}').otherwise(F.col("input")), "model_visible_metadata": F.when(F.col("k") % 60 == 7, "{}").otherwise(F.col("model_visible_metadata")),
        "expected": F.when(F.col("k") % 29 == 0, '{"status":"O"}').otherwise(F.col("expected")),
    })
    return preflight.doctor(cases, ORDERS, strict=True, include=("/input", "/model_visible_metadata"))


# Sources


@query
def mapped_import(spark: SparkSession, d: str) -> DataFrame:
    """Outputs from lines of another shape, parts found by pointers, errors of every form."""
    good, _ = records.mapped_outputs(_foreign_lines(spark, d), "/ref", "/answer", _MAPPING)
    return good.groupBy("status", "error_kind", "error_message").agg(F.count("*").alias("n"), F.count("raw_output").alias("outputs"), F.sum("latency_ms").cast("long").alias("latency_ms"), F.sum("input_tokens").cast("long").alias("input_tokens"))


@query
def mapped_import_violations(spark: SparkSession, d: str) -> DataFrame:
    _, bad = records.mapped_outputs(_foreign_lines(spark, d), "/ref", "/answer", _MAPPING)
    return bad.groupBy("violation").agg(F.count("*").alias("n"))


_MAPPING = {"status": "/state", "latency_ms": "/took", "usage": "/tokens", "error": "/why"}


def _foreign_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    part = lambda when, text: F.when(when, F.concat(F.lit(","), text)).otherwise("")
    why = F.when(k % 4 == 1, F.lit('"why":{"kind":"provider","message":"busy"}')).when(k % 4 == 2, F.lit('"why":"gone"')).when(k % 4 == 3, F.lit('"why":[1]'))
    state = F.when(k % 9 == 0, "error").when(k % 11 == 0, "missing").when(k % 101 == 0, "odd").otherwise("ok")
    line = F.concat(
        F.lit('{"ref":'), F.when(k % 103 == 0, F.lit('" "')).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"'))), part(state != "ok", F.concat(F.lit('"state":"'), state, F.lit('"'))),
        part(k % 107 != 0, F.concat(F.lit('"answer":'), F.col("props"))), part((state == "error") & why.isNotNull(), why), F.lit(',"took":'), (k % 100).cast("string"), F.lit(',"tokens":{"input_tokens":'), (k % 10).cast("string"), F.lit("}}"),
    )
    return table(spark, d, "events").select(k.alias("source_line"), F.when(k % 109 == 0, F.lit("{")).otherwise(line).alias("line"))


@query
def csv_typed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a file by their types: numbers, truth values, objects; quoted JSON strings and padded numbers stay texts."""
    from pairwright.functions.json import json_type
    e, path = table(spark, d, "events"), shared_path(spark, "typed")
    cells = {"id": F.lpad(F.col("event_id").cast("string"), 8, "0"), "n": F.col("event_id").cast("string"), "yes": (F.col("event_id") % 2 == 0).cast("string"), "props": F.col("props"), "said": F.concat(F.lit('"'), "event_type", F.lit('"'))}
    e.select(*(c.alias(n) for n, c in cells.items())).write.option("header", True).option("escape", '"').csv(path)
    return records.typed_cells(spark, path).groupBy(*(json_type(F.col(n)).alias(n) for n in cells)).agg(F.count("*").alias("rows"))


@query
def token_remap(spark: SparkSession, d: str) -> DataFrame:
    """Outputs named by opaque tokens under their cases' ids again; a token of no case is dropped."""
    cases = order_cases(spark, d)
    named = cases.select(F.when(F.col("k") % 23 == 0, "case-unknown").otherwise(pairing.execution_token("run-1", F.col("k"))).alias("case_id"), F.col("k").alias("said"))
    return pairing.remapped(named, cases, "run-1", F.col("k")).select("case_id", "said")


# Cases after a run


@query
def structural_differences(spark: SparkSession, d: str) -> DataFrame:
    """Ends of two documents by state, items of arrays aligned by their id."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").cast("long").alias("q"))
    item = lambda q: F.to_json(F.struct(F.col("l_linenumber").cast("string").alias("id"), q.alias("q")))
    part, q = F.col("part"), F.col("q").cast("string")
    changed = F.when(part % 29 == 0, F.concat(F.lit('"'), q, F.lit('"'))).when(part % 17 == 0, (F.col("q") + 1).cast("string")).otherwise(q)
    said = F.concat(F.lit('{"q":'), changed, F.lit(',"id":"'), F.col("l_linenumber").cast("string"), F.lit('"}'))
    whole = lambda items: F.concat(F.lit('{"items":['), F.array_join(items, ","), F.lit("]}"))
    rows = li.groupBy("l_orderkey").agg(whole(F.array_sort(F.collect_list(item(F.col("q"))))).alias("e"), whole(F.reverse(F.array_sort(F.collect_list(F.when(part % 23 != 0, said))))).alias("a"))
    return rows.select(F.explode(structural_diff(F.col("e"), F.col("a"))).alias("x")).groupBy("x.state").agg(F.count("*").alias("n"))


@query
def outcome_displays(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes and transitions in a reader's words."""
    p = order_pairs(spark, d)
    shown = lambda s: outcomes.display(F.col(f"{s}.truth"), F.col(f"{s}.fully_evaluated"))
    moved = outcomes.transition_display(pairing.transition(F.col("baseline.semantic_success"), F.col("candidate.semantic_success")))
    return p.groupBy(shown("baseline").alias("baseline"), shown("candidate").alias("candidate"), moved.alias("transition")).agg(F.count("*").alias("n"))


@query
def first_failures(spark: SparkSession, d: str) -> DataFrame:
    """Of each evaluation that is wrong, the pointer of the first component that failed."""
    e = order_evaluations(spark, d)
    return e.groupBy("variant", first_failure({r.id: F.col(f"{r.id}_state") for r in ORDERS.rules}, ORDERS).alias("pointer")).agg(F.count("*").alias("n"))


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    cases = order_cases(spark, d).select("id", review.search_text(F.col("expected"), ["/priority", "/status"], F.col("id")).alias("search_text"))
    p = review.filters(order_pairs(spark, d))
    return p.join(cases, p["case_id"] == cases["id"]).select("case_id", F.col("baseline.k").alias("k"), "transition", "filters", "search_text")


@query
def case_page_search(spark: SparkSession, d: str) -> DataFrame:
    """The page is the feature: regressions that a search finds, five from the fourth on, with their number."""
    return review.case_page(_searchable(spark, d), "k", name="regressions", query="urgent", limit=5, offset=3).select("k", "transition", "total")


@query
def case_page_pinned(spark: SparkSession, d: str) -> DataFrame:
    """The page is the feature: the first 40 saved cases, with their number; a case saved twice is there once."""
    pins = order_cases(spark, d).where("k % 10 = 3").select(F.col("id").alias("case_id"))
    return review.case_page(_searchable(spark, d), "k", name="pinned", pins=pins.union(pins), limit=40).select("k", "transition", "total")


@query
def pointer_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Pointers of lines that patterns match, of whose steps a star is any."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("/orders/"), (F.col("l_orderkey") % 10).cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("pointer"))
    patterns = F.array(*(F.lit(x) for x in ("/orders/*/1", "/orders/3/*", "/*/*/*", "/orders/*", "/orders/7/2")))
    rows = li.select("pointer", F.explode(patterns).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count_if(review.matches(F.col("pattern"), F.col("pointer"))).alias("n"))


@query
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts cut to 101 bytes of UTF-8, never inside a character; accents are planted so that cuts meet them."""
    wide = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("é")), F.lit("t"), F.lit("日"))
    return table(spark, d, "documents").select("doc_id", F.md5(truncated(wide, 101).cast("binary")).alias("digest"))


@query
def decision_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one decision under every state of the evidence, and with saved cases that block."""
    from pairwright.plans.queries import gate_decision

    states = F.array(*(F.struct(F.lit(i).alias("integrity"), F.lit(b).alias("blocking")) for i in ("verified", "modified", "replay_failed", "not_verified") for b in (False, True)))
    rows = gate_decision(spark, d).select("*", F.explode(states).alias("s")).select("*", "s.*")
    return gate.headline(rows, F.col("integrity"), F.col("blocking"), release=True).select("integrity", "blocking", "title")


# Replays


def _wanted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What should be on record, what a run's cases tell, and its receipts with planted faults."""
    k = F.col("k")
    results = order_cases(spark, d).select(F.col("id").alias("case_id"), k, F.explode(F.array(F.lit("baseline"), F.lit("candidate"))).alias("variant"), F.lit("mine").alias("evaluator"), F.when(k % 3 == 0, "failed").otherwise("passed").alias("status"))
    made = lambda rows, request, response: receipts.receipts(rows, request, response, F.lit("v1"))
    wanted = made(results, k, F.col("status")).drop("status")
    found = made(results.where("k % 31 <> 0"), k + F.when(k % 37 == 0, 1).otherwise(0), F.when(k % 41 == 0, "other").otherwise(F.col("status")))
    more = made(results.where("k % 43 = 0").withColumn("evaluator", F.lit("old")), k, F.col("status"))
    told = results.withColumn("status", F.when(k % 47 == 0, "error").otherwise(F.col("status")))
    return wanted, told, found.union(more).union(found.where("cast(case_id AS long) % 53 = 0"))


@query
def receipt_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return receipts.verified(*_wanted(spark, d)).groupBy("variant", "evaluator", "mismatch").agg(F.count("*").alias("n"))


@query
def repeated_receipts(spark: SparkSession, d: str) -> DataFrame:
    return receipts.repeated(_wanted(spark, d)[2]).select(F.col("case_id").cast("long").alias("k"), "variant", "n")


@query
def replay_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a replay, and its verdict."""
    stored = order_evaluations(spark, d).where("variant = 'baseline'").select("k", "truth", "parse_valid")
    again = stored.where("k % 101 <> 0")
    artifacts = spark.createDataFrame([("evaluations", True), ("summary", False)], "relation string, intact boolean")
    return receipts.replay_report(stored, review.replayed(stored, again, "k", ["truth", "parse_valid"]), receipts.verified(*_wanted(spark, d)), artifacts)
