"""Truth tables and small runs for evaluators, outcomes, evidence, the gate and reviews."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairwright.operators import evaluators as E
from pairwright.operators import evidence, gate, outcomes, profile, review
from pairwright.plans.paired import Evaluation, pairs
from pairwright.sources import records


def state(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_bad_reference_is_an_error_bad_output_fails(spark):
    table = [
        (E.exact, None, None, "error"), (E.exact, "1", None, "failed"), (E.exact, "1.0", "1", "failed"), (E.exact, "null", "null", "passed"),
        (E.normalized_string, "1", '"a"', "error"), (E.normalized_string, '"a"', "1", "failed"), (E.normalized_string, '"A  b"', '" a B "', "passed"),
        (E.canonical_date, '"x"', '"2024-01-01"', "error"), (E.canonical_date, '"2024-01-01"', '"2024-13-01"', "failed"), (E.canonical_date, '"2024-01-01"', '"2024-1-1"', "passed"),
        (E.exact_integer, '"x"', "1", "error"), (E.exact_integer, "1", '"x"', "failed"), (E.exact_integer, "7", '"007"', "passed"), (E.exact_integer, None, None, "failed"),
        (E.numeric_tolerance, "true", "1", "error"), (E.numeric_tolerance, "1", "[]", "failed"), (E.numeric_tolerance, "1.50", '"1.5"', "passed"), (E.numeric_tolerance, None, "1", "error"),
    ]
    for make, e, a, want in table:
        assert state(spark, make, e, a) == want, (make, e, a)
    assert state(spark, lambda e, a: E.numeric_tolerance(e, a, relative="0.1"), "0", "0.01") == "failed"
    assert state(spark, lambda a, b: E.required_fields(a, b), "1", "null") == "failed"


def test_outcomes(spark):
    def both(*s):
        df = spark.createDataFrame([(list(s),)], "s array<string>")
        r = df.select(outcomes.all_of(F.col("s")).alias("a"), outcomes.any_of(F.col("s")).alias("o"), outcomes.fully_evaluated(F.col("s")).alias("f")).first()
        return r.a, r.o, r.f

    p, f, e, n = "passed", "failed", "error", "not_applicable"
    assert both(p, p) == ("true", "true", True) and both(p, f) == ("false", "true", True) and both(f, e) == ("false", "error", False)
    assert both(p, e) == ("error", "true", False) and both(p, n) == ("not_applicable", "true", False) and both(n, n) == ("not_applicable", "not_applicable", False)
    assert both(f, n) == ("false", "false", False) and both(p, None) == ("error", "error", False)


def test_keyed_arrays(spark):
    item = "array<struct<id:string,q:decimal(12,2)>>"
    one, two, three = map(Decimal, (1, 2, 3))
    rows = [([("a", one), ("b", two)], [("b", two), ("a", one)]), ([("a", one)], [("a", three), ("c", one)]), ([("a", one), ("a", one)], [("a", one)]), ([("a", one)], [("a", one), ("a", one)]), (None, []), ([("a", one)], None), ([("a", one)], [(None, one)])]
    df = spark.createDataFrame(rows, f"e {item}, a {item}").coalesce(1)
    got = [r.x for r in df.select(E.keyed_array(F.col("e"), F.col("a"), "id", {"q": "0.5"}).alias("x")).collect()]
    assert [g.status for g in got] == ["passed", "failed", "error", "failed", "error", "failed", "failed"]
    assert (got[1].missing, got[1].extra, got[1].mismatched) == ([], ["c"], 1)


def test_runs_keep_every_case(spark):
    lines = spark.createDataFrame([(1, '{"id":"a","input":1,"expected":{"x":"1.0"}}'), (2, '{"id":"b","input":2,"expected":{"x":"2"}}'), (3, '{"id":"c","input":3,"expected":{"x":"3"}}')], "source_line long, line string")
    cases, violations = records.cases(lines)
    assert violations.count() == 0
    out = lambda *rows: records.outputs(spark.createDataFrame(list(enumerate(rows, 1)), "source_line long, line string"), cases)
    b, bad_b = out('{"case_id":"a","raw_output":"{\\"x\\":\\"1.0\\"}"}', '{"case_id":"b","raw_output":"so: {}"}')
    c, bad_c = out('{"case_id":"a","parsed_output":{"x":"1"}}', '{"case_id":"b","status":"error","error":{"kind":"timeout"}}', '{"case_id":"c","parsed_output":{"x":"3"}}')
    assert bad_b.count() == bad_c.count() == 0
    rows = {r.case_id: r for r in pairs(cases, b, c, Evaluation((("x", "/x", "exact"),))).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].baseline.truth, rows["a"].candidate.truth) == ("true", "false")
    assert (rows["b"].baseline.status, rows["b"].baseline.parse_valid, rows["b"].candidate.error_kind) == ("ok", False, "timeout")
    assert (rows["c"].baseline.status, rows["c"].candidate.deployment_success) == ("missing", True)


def test_faulty_lines_are_no_rows(spark):
    """Blank, malformed, repeated and unknown lines are violations and stay out of what is paired."""
    lines = ['{"id":"a","input":1}', "", "{bad", '{"id":"a","input":2}', '{"id":" ","input":3}', '{"id":"b"}', '{"id":"c","input":4}']
    cases, bad = records.cases(spark.createDataFrame(list(enumerate(lines, 1)), "source_line long, line string"))
    assert sorted((r.id, r.source_line) for r in cases.collect()) == [("a", 1), ("c", 7)]
    assert sorted((r.source_line, r.violation) for r in bad.collect()) == [(2, "blank_line"), (3, "malformed_json"), (4, "duplicate_id"), (5, "bad_id"), (6, "missing_input")]
    lines = ['{"case_id":"a","raw_output":"1"}', '{"case_id":"a","raw_output":"2"}', '{"case_id":"a","raw_output":"3"}', '{"case_id":"z","raw_output":"1"}', '{"case_id":"c"}', "{bad"]
    out, bad = records.outputs(spark.createDataFrame(list(enumerate(lines, 1)), "source_line long, line string"), cases)
    assert [(r.case_id, r.raw_output) for r in out.collect()] == [("a", "1")]
    assert sorted((r.source_line, r.violation) for r in bad.collect()) == [(2, "duplicate_id"), (3, "duplicate_id"), (4, "unknown_id"), (5, "ok_without_output"), (6, "malformed_json")]


def test_evidence(spark):
    rows = [(1, "s1", "x"), (2, "s2", "x"), (3, "s2", "x"), (4, "s3", "x"), (5, "s3", "y"), (6, None, "z")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id int, s string, o string")
        stimulus, seen = evidence.digest(F.col("s")), evidence.digest(F.col("o"))
        assert sorted(r.id for r in evidence.independent(df, stimulus, seen, "id").collect()) == [1, 2, 6]
        s = evidence.unit_summary(evidence.units(df, stimulus, seen)).first()
        assert (s.units, s.singletons, s.duplicate_groups, s.repeated_trial_groups, s.effective_units, s.exact_duplicate_rows) == (4, 2, 1, 1, 3, 1)
    conflicts = evidence.label_conflicts(df, stimulus, seen).collect()
    assert [(r.references, r.rows) for r in conflicts] == [(2, 2)]


def test_gate(spark):
    good = {i: 0.0 for i in gate.INPUTS} | {"effective_units": 100.0, "fully_evaluated_rate": 1.0, "candidate_primary_rate": 0.9}
    limits = {"min_cases": 10.0, "min_unique_cases": 10.0, "max_duplicate_case_rate": 0.1, "min_primary_fully_evaluated_rate": 0.9, "max_primary_component_error_rate": 0.1, "max_primary_component_not_applicable_rate": 0.1, "max_primary_component_unscored_rate": 0.1}

    def decide(inputs, more=None, release=True):
        df = spark.createDataFrame([tuple(inputs[i] for i in gate.INPUTS)], ", ".join(f"{i} double" for i in gate.INPUTS))
        found = gate.rules(df, limits | (more or {}))
        assert found.count() == 26
        r = gate.decision(found, release=release).first()
        return r.decision, r.deployment_authorized

    assert decide(good) == ("passed", False)  # lax limits authorise nothing, whatever passes
    safe = {"candidate_deployment_rate": 1.0, "candidate_parse_rate": 1.0, "candidate_schema_rate": 1.0}
    assert decide(good | safe, gate.PROFILE) == ("passed", True) and decide(good | safe, gate.PROFILE, release=False) == ("passed", False)
    for name, bound in gate.PROFILE.items():
        laxer = gate.PROFILE | {name: bound * 0.99 if name.startswith("min") else bound + 0.001}
        assert gate.lax(laxer) == [name] and gate.lax({k: v for k, v in gate.PROFILE.items() if k != name}) == [name]
        assert decide(good | safe, laxer) == ("passed", False), name
    assert decide(good | {"effective_units": 5.0}) == ("insufficient_evidence", False)
    assert decide(good, {"min_candidate_primary_success_rate": 0.95}) == ("failed", False)
    assert decide(good | {"effective_units": 5.0}, {"min_candidate_primary_success_rate": 0.95})[0] == "insufficient_evidence"
    assert decide(good | {"label_conflicts": 1.0, "effective_units": 5.0})[0] == "error"
    assert decide(good | {"p95_increase_percent": None}, {"max_p95_latency_increase_percent": 5.0})[0] == "insufficient_evidence"
    with pytest.raises(ValueError):
        decide(good, {"no_such_rule": 1.0})
    df = spark.createDataFrame([tuple((good | {"label_conflicts": 3.0})[i] for i in gate.INPUTS)], ", ".join(f"{i} double" for i in gate.INPUTS))
    assert gate.decision(gate.rules(df, {}), release=True).first().decision == "not_configured"


def test_pins_and_pages(spark):
    table = [(True, True, None, "passing"), (True, False, None, "fixed"), (False, True, None, "reintroduced"), (False, False, "fixed", "reintroduced"), (False, False, "still_broken", "still_broken"), (None, True, "passing", "missing")]
    df = spark.createDataFrame(table, "p boolean, o boolean, b string, want string").withColumn("got", review.pin_status(F.col("p"), F.col("o"), F.col("b")))
    assert df.where("got <> want").count() == 0
    with pytest.raises(ValueError):
        review.page(df, "want", 501)
    assert review.search(df, F.col("want"), "PASS").count() == 1 and review.search(df, F.col("want"), "%").count() == 0


def test_external_evaluator_survives_its_code(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(6)], "case_id string, v int")

    def broken(batch):
        raise RuntimeError("no")

    assert {r.status for r in E.external(df, "x", broken).collect()} == {"error"}
    some = E.external(df.where("v < 3"), "x", lambda b: b["v"].map({0: "passed", 1: "failed"}).fillna("odd"))
    assert {r.case_id: r.status for r in E.with_external(df, some).collect()} == {"0": "passed", "1": "failed", **{str(i): "error" for i in range(2, 6)}}


def planned(spark, rule, expected, output):
    """The state that a plan of one rule gives a pair of JSON texts."""
    from pairwright.plans.paired import evaluate

    cases = spark.createDataFrame([("a", expected)], "id string, expected string")
    out = spark.createDataFrame([("a", "ok", None, output)], "case_id string, status string, error_kind string, raw_output string")
    return evaluate(cases, out, "v", Evaluation((rule,))).first()[f"{rule.id}_state"]


def test_all_kinds_in_plans(spark):
    from pairwright.plans.paired import KINDS, Rule

    table = [
        (Rule("x", "exact", ("/a",)), '{"a":1.0}', '{"a":1}', "failed"), (Rule("x", "enum_accuracy", ("/a",)), '{"a":"b"}', '{"a":"b"}', "passed"),
        (Rule("x", "normalized_string", ("/a",)), '{"a":"CAF\\u00c9  X"}', '{"a":"cafe\\u0301 x"}', "passed"), (Rule("x", "normalized_string", ("/a",), options={"case_insensitive": False}), '{"a":"A"}', '{"a":"a"}', "failed"),
        (Rule("x", "canonical_date", ("/a",), options={"formats": ("iso", "dmy_dot")}), '{"a":"2024-02-09"}', '{"a":"9.2.2024"}', "passed"), (Rule("x", "canonical_date", ("/a",)), '{"a":"2023-02-30"}', '{"a":"2024-01-01"}', "error"),
        (Rule("x", "exact_integer", ("/a",)), '{"a":7}', '{"a":"007"}', "passed"), (Rule("x", "decimal", ("/a",), options={"absolute": "0.05"}), '{"a":"1e3"}', '{"a":1000.04}', "passed"),
        (Rule("x", "decimal_exact", ("/a",)), '{"a":1.50}', '{"a":"1.5"}', "passed"), (Rule("x", "decimal", ("/a",), options={"relative": "0.01"}), '{"a":100}', '{"a":102}', "failed"),
        (Rule("x", "pointers_exact", ("/a", "/b")), '{"a":1,"b":2}', '{"a":1}', "failed"), (Rule("x", "tool_arguments", ("/a", "/b")), '{"a":1}', '{"a":1,"b":2}', "error"),
        (Rule("x", "tool_selection", ("/name",), ("/tool",)), '{"tool":"f"}', '{"name":"f"}', "passed"), (Rule("x", "required_fields", ("/a",)), "{}", '{"a":null}', "failed"),
    ]
    keyed = Rule("x", "keyed_array", ("/i",), options={"keys": {"/id": "normalized_string", "/n": "exact"}, "fields": {"/q": ("decimal", {"absolute": "0.5"}), "/d": ("canonical_date", {}), "/s": ("normalized_string", {})}})
    item = lambda i, n, q, d="2024-01-01", s="A": f'{{"id":"{i}","n":{n},"q":{q},"d":"{d}","s":"{s}"}}'
    items = lambda *x: f'{{"i":[{",".join(x)}]}}'
    table += [
        (keyed, items(item("A", 1, 2), item("a", 2, 3)), items(item("a", 2, 3.4, "2024-1-1"), item(" a", 1, 2, s="a ")), "passed"), (keyed, items(item("A", 1, 2)), items(item("a", 1, 3)), "failed"),
        (keyed, items(item("A", 1, 2)), items(item("a", 1, 2), item("b", 1, 2)), "failed"), (keyed, items(item("A", 1, 2), item("a", 1, 2)), items(item("a", 1, 2)), "error"),
        (keyed, items(item("A", 1, 2)), items(item("a", 1, 2), item("a ", 1, 2)), "failed"), (keyed, items(item("A", 1, 2, "x")), items(item("a", 1, 2)), "error"),
        (keyed, items(item("A", 1, 2)), '{"i":{"id":"a"}}', "failed"), (keyed, '{"i":7}', items(), "error"), (keyed, items(), items(), "passed"), (keyed, items('{"n":1}'), items(), "error"),
    ]
    sums = Rule("x", "financial_invariants", ("/l", "/s", "/t", "/g"), options={"tolerance": "0.01", "line": ("/q", "/p", "/a")})
    money = lambda a, s, g: f'{{"l":[{{"q":2,"p":"1.5","a":{a}}}],"s":{s},"t":"0.5","g":{g}}}'
    table += [(sums, "{}", money(3, '"3.00"', "3.5e0"), "passed"), (sums, "{}", money(3.02, 3.02, 3.52), "failed"), (sums, "{}", money('"x"', 3, 3.5), "error"), (sums, "{}", money(3, 3, 4), "failed"), (sums, "{}", '{"s":1}', "error")]
    for rule, expected, output, want in table:
        assert planned(spark, rule, expected, output) == want, (rule, expected, output)
    assert {r.kind for r, *_ in table} | {"external"} == set(KINDS)


def test_plans_are_checked():
    from pairwright.plans.paired import Rule

    fine = ("a", "/a", "exact")
    for bad in (
        (), (fine, fine), (("a", "a", "exact"),), (("a", "/a", "odd"),), (Rule("a", "pointers_exact"),), (Rule("a", "exact", ("/a",), ("/b", "/c")),), (Rule("a", "exact", ("/a",), options={"x": 1}),),
        (Rule("a", "canonical_date", ("/a",), options={"formats": ("dmy_slash", "mdy_slash")}),), (Rule("a", "canonical_date", ("/a",), options={"formats": ("odd",)}),), (Rule("a", "keyed_array", ("/a",)),),
        (Rule("a", "keyed_array", ("/a",), options={"keys": {"/k": "exact"}, "fields": {"/k/x": ("exact", {})}}),),
    ):
        with pytest.raises(ValueError):
            Evaluation(bad)
    with pytest.raises(ValueError):
        Evaluation((fine,), primary=("b",))
    assert Evaluation((fine, ("b", "/b", "exact")), primary=("b",)).components == ("b",)


def test_tokens_lead_back(spark):
    from pairwright.operators import pairing

    cases = spark.createDataFrame([("x", 1), ("y", 2)], "id string, n long")
    hidden = cases.select(pairing.execution_token("r", F.col("n")).alias("case_id"), "n").union(spark.createDataFrame([("case-odd", 3)], "case_id string, n long"))
    assert {(r.case_id, r.n) for r in pairing.remapped(hidden.withColumnRenamed("n", "v"), cases, "r", F.col("n")).select("case_id", F.col("v").alias("n")).collect()} == {("x", 1), ("y", 2)}


def test_schema_inspection():
    schema = {"type": "object", "properties": {"a": {"$ref": "#/properties/b"}, "b": {"type": ["string", "null"], "properties": {"c": {"$ref": "#/properties/a"}}}}}
    assert ("/b", "string|null", False) in profile.inspect_schema(schema) and ("/b", "nullable_union") in profile.schema_warnings(schema)
    assert profile.schema_warnings({"$ref": "http://x/y"}) == [("/", "unresolved_reference")]


def test_gate_inputs_are_computed(spark):
    from pairwright.functions import stats

    def side(ok, parts=("passed",), ms=10):
        return ("ok", None, True, True, list(parts), ok, ok, not ok, None not in parts and len(parts) > 0, ms, None, None)

    # (case, stimulus, reference, baseline, candidate): a copy, a repeated trial, two labels of one stimulus, components without a state.
    rows = [(f"c{i}", f"s{i}", "r", side(True), side(i % 3 != 0)) for i in range(20)]
    rows += [("c0-copy", "s0", "r", side(True), side(False)), ("c1-again", "s1", "r", side(True), side(True, ms=11)), ("c2-label", "s2", "other", side(True), side(True))]
    rows += [("lost", "s20", "r", side(True), side(False, ["passed", None])), ("bare", "s21", "r", side(True), side(False, []))]
    of = "struct<status:string,error_kind:string,parse_valid:boolean,schema_valid:boolean,components:array<string>,semantic_success:boolean,deployment_success:boolean,valid_but_wrong:boolean,fully_evaluated:boolean,latency_ms:long,cost:double,currency:string>"
    df = spark.createDataFrame(rows, f"case_id string, stimulus string, reference string, baseline {of}, candidate {of}")
    seen = evidence.digest(F.to_json("baseline"), F.to_json("candidate"))
    found = lambda rows, **more: gate.inputs(rows, stimulus=F.col("stimulus"), reference=F.col("reference"), observation=seen, **more)
    r = found(df, samples=500, seed=3).first()
    assert (r.repeated_trial_groups, r.label_conflicts, r.effective_units, r.duplicate_row_rate) == (1, 1, 22, 0.04)
    assert r.component_unscored_rate == round(2 / 23, 9) and r.fully_evaluated_rate == round(20 / 22, 9)
    # Of 20 units whole on both sides 7 lose; for the deployment so do the two without a state.
    for got, n in ((r.primary_regression_bound_pp, (13, 7, 0, 0)), (r.deployment_regression_bound_pp, (13, 9, 0, 0))):
        assert got == round(-stats.bootstrap(*n, 500, 0.95, 3)[0], 9) > 0
    by = {x.rule: x.status for x in gate.rules(found(df, samples=500), {"max_upper_confidence_bound_regression_pp": 5.0, "max_primary_component_unscored_rate": 0.0, "max_duplicate_case_rate": 0.0}).collect()}
    assert by["repeated_trial_model"] == by["max_primary_component_unscored_rate"] == by["max_duplicate_case_rate"] == "insufficient_evidence"
    assert by["dataset_label_conflicts"] == "error" and by["max_upper_confidence_bound_regression_pp"] == "failed"
    # Nothing to compare: effects and bounds are unknown, not zero; so too without a bootstrap.
    empty = found(df.limit(0), samples=500).first()
    assert (empty.effective_units, empty.primary_regression_pp, empty.deployment_regression_bound_pp) == (0, None, None)
    assert found(df).first().primary_regression_bound_pp is None


def test_budgets_in_order(spark):
    """What is left of a run's budget, as adding up in order would have it; runs of one, gaps, ties of sizes, null runs."""
    r = random.Random(2)
    rows = [(run, at, r.randrange(0, 30)) for run, n, step in (("a", 400, 1), ("b", 1, 1), (None, 50, 10**9), ("c", 300, 3)) for at in r.sample(range(0, n * step + 1, step), n)] + [("c", 10**15, 5)]
    df = spark.createDataFrame(rows, "run_id string, at long, bytes long").repartition(4)
    got = {(x.run_id, x.at): (x.remaining, x.kept_bytes) for x in review.within_budget(df, "at", F.col("bytes"), 2000).collect()}
    assert len(got) == len(rows)
    spent = {}
    for run, at, size in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        left = max(0, 2000 - spent.get(run, 0))
        assert got[run, at] == (left, min(size, left)), (run, at)
        spent[run] = spent.get(run, 0) + size
    times = df.select("run_id", F.timestamp_micros("at").alias("at"), "bytes")
    assert review.within_budget(times, "at", F.col("bytes"), 2000).agg(F.sum("kept_bytes")).first()[0] == sum(k for _, k in got.values())
