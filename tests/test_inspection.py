"""Schemas, differences, units, receipts, imports and configurations on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions import schema as S
from pairwright.functions.json import parse, scalars, structural_diff
from pairwright.functions.text import truncated
from pairwright.operators import evidence, gate, outcomes, receipts, review
from pairwright.plans import config, preflight
from pairwright.plans.paired import Evaluation, reference_issues
from pairwright.sources import records


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_schema_errors(spark):
    found = lambda rules, text: one(spark, lambda c: S.schema_errors(c, json.dumps(rules)), text)
    rules = {
        "type": "object", "required": ["a", "b"], "additionalProperties": False, "$defs": {"n": {"type": "integer", "minimum": 1}},
        "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"type": "array", "items": {"$ref": "#/$defs/n"}, "uniqueItems": True, "maxItems": 3}, "s": {"pattern": "^x", "minLength": 2, "maxLength": 3}},
    }
    pairs = lambda text: [tuple(x) for x in found(rules, text)]
    assert pairs('{"a":1,"b":[1,2]}') == [] and pairs('{"a":1.0,"b":[]}') == []
    assert pairs('{"b":[0,"x",1,1.0],"z":1}') == [("/a", "required"), ("/b", "maxItems"), ("/b", "uniqueItems"), ("/b/0", "minimum"), ("/b/1", "type"), ("/z", "additionalProperties")]
    assert pairs('{"a":1.5,"b":[],"s":"y"}') == [("/a", "type"), ("/s", "minLength"), ("/s", "pattern")]
    assert found(rules, "{") is None and found(rules, None) is None
    assert [tuple(x) for x in found({"oneOf": [{"const": 1}, {"enum": [1.0, 2]}]}, "1")] == [("", "oneOf")] and found({"oneOf": [{"const": 1}, {"enum": [1.0, 2]}]}, "2") == []
    assert [tuple(x) for x in found({"anyOf": [{"type": "string"}, {"exclusiveMinimum": 3}], "not": {"const": 3}}, "3")] == [("", "anyOf"), ("", "not")]
    assert [tuple(x) for x in found({"const": 100}, "1e2")] == [] and found({"maximum": 10}, "1e999999999") is not None
    loop = {"$defs": {"t": {"properties": {"next": {"$ref": "#/$defs/t"}}, "type": "object"}}, "$ref": "#/$defs/t"}
    assert found(loop, '{"next":{"next":{}}}') == [] and [tuple(x) for x in found(loop, '{"next":{"next":1}}')] == [("/next/next", "type")]
    for bad in ({"dependentSchemas": {}}, {"$ref": "#/nowhere"}, {"pattern": "("}, 3):
        with pytest.raises(ValueError):
            S.schema_errors(F.col("x"), json.dumps(bad))


def test_inferred_schema_takes_its_own_value(spark):
    value = {"a": 1, "b": [{"c": "x"}], "d": None, "e": 1.5, "f": True, "g": []}
    rules = S.inferred_schema(parse(json.dumps(value)))
    assert rules["properties"]["e"] == {"type": "number"} and rules["additionalProperties"] is False
    assert one(spark, lambda c: S.schema_errors(c, json.dumps(rules)), json.dumps(value)) == []


def test_structural_diff(spark):
    rows = lambda e, a: None if (found := one(spark, structural_diff, e, a)) is None else [(x.path, x.state) for x in found]
    assert rows('{"i":[{"id":"a","q":1},{"id":"b","q":2}]}', '{"i":[{"q":3,"id":"b"},{"id":"c"},{"id":"a","q":"1"}]}') == [
        ("/i/0/id", "unchanged"), ("/i/0/q", "type_changed"), ("/i/1/id", "unchanged"), ("/i/1/q", "changed"), ("/i/2/id", "added"),
    ]
    assert rows("[1,2]", "[1]") == [("/0", "unchanged"), ("/1", "removed")] and rows('{"a":1}', '{"a":{"b":1}}') == [("/a", "removed"), ("/a/b", "added")]
    assert rows("{}", "[]") == [("", "type_changed")] and rows("1", "{") is None and rows(None, "1") is None and rows('{"a/b":1}', "{}") == [("", "added"), ("/a~1b", "removed")]


def test_truncation_never_cuts_a_character(spark):
    for text in ("plain", "", "é日本😀" * 3, "😀", "aé"):
        for size in range(1, 20):
            raw = text.encode()
            want = text if len(raw) <= size else raw[:size].decode(errors="ignore") + "|"
            assert one(spark, lambda c: truncated(c, size, "|"), text) == want, (text, size)
    assert one(spark, lambda c: truncated(c, 3), None) is None


def test_units(spark):
    rows = [("a", "1", "2", None, '{"u":"x"}'), ("b", "1", "2", None, '{"u":"y"}'), ("c", "1", "3", "{}", "{}"), ("d", "1", None, None, None)]
    cases = spark.createDataFrame(rows, "id string, input string, expected string, model_visible_metadata string, metadata string").coalesce(1)
    known, lost = evidence.with_units(cases)
    units = {r.id: r.unit for r in known.collect()}
    assert units["a"] == units["b"] and len(set(units.values())) == 3 and lost.count() == 0
    known, lost = evidence.with_units(cases, pointer="/metadata/u")
    assert {r.id for r in known.collect()} == {"a", "b"} and [tuple(r) for r in lost.orderBy("id").collect()] == [("c", "/metadata/u"), ("d", "/metadata/u")]
    assert evidence.unit_label("/x") == "pointer:/x" and evidence.unit_label() == "fingerprint:/input,/expected,/model_visible_metadata"
    for wrong in ({"pointer": "/x", "include": ("/y",)}, {"include": ()}, {"include": ("y",)}):
        with pytest.raises(ValueError):
            evidence.with_units(cases, **wrong)


def test_leaks_and_references(spark):
    rows = [("case-x-1", "1", '{"d":[{"v":"gold"}]}', '{"a":"gold","n":null}'), ("case-gold-2", "2", '{"v":"goldish"}', '{"a":"gold"}'), ("c", "3", '{"n":null,"b":1.0}', '{"a":null,"b":1}'), ("d", "4", None, None)]
    cases = spark.createDataFrame(rows, "id string, k string, input string, expected string").coalesce(1)
    assert [(r.gold_visible, r.id_suspicious) for r in preflight.leaks(cases).orderBy("k").collect()] == [(True, False), (False, True), (False, False), (False, False)]
    plan = Evaluation((("a", "/a", "normalized_string"),))
    assert sorted((r.id, r.state) for r in reference_issues(cases, plan).collect()) == [("c", "error"), ("d", "error")]
    assert one(spark, scalars, '{"a":[1,null,{"b":"x"}],"c":true}') == ["1", '"x"', "true"] and one(spark, scalars, None) == []
    checks = {r.check: (r.passed, r.cases) for r in preflight.doctor(cases.withColumn("model_visible_metadata", F.lit(None).cast("string")), plan, strict=True).collect()}
    assert checks["reference_preflight"] == (False, 2) and checks["golden_value_isolation"] == (False, 1) and checks["potential_evidence_collisions"] == (True, 0)


def test_receipts(spark):
    rows = [("a", "baseline", "e", "passed"), ("b", "baseline", "e", "failed")]
    results = spark.createDataFrame(rows, "case_id string, variant string, evaluator string, status string").coalesce(1)
    made = lambda df: receipts.receipts(df, F.col("case_id"), F.col("status"), F.lit("1"))
    wanted = made(results).drop("status")
    assert receipts.verified(wanted, results, made(results)).count() == 0
    told = results.withColumn("status", F.lit("passed"))
    stray = made(results.where("case_id = 'a'").withColumn("case_id", F.lit("z")))
    found = made(results.where("case_id = 'b'")).union(stray)
    assert sorted((r.case_id, r.mismatch) for r in receipts.verified(wanted, told, found).collect()) == [("a", "missing"), ("b", "result"), ("z", "unused")]
    nothing = made(results.where("false"))
    assert receipts.verified(wanted, told, nothing).count() == 2 and receipts.verified(wanted.where("false"), told, nothing).count() == 0


def test_imports_of_other_shapes(spark):
    lines = spark.createDataFrame([(1, '{"record_id":"a","prediction":{"x":1.0},"t":5}'), (2, '{"record_id":"b","status":"error","why":{"code":1}}'), (3, '{"record_id":"c","prediction":"text"}'), (4, '{"prediction":1}'), (5, "nope"), (6, '{"record_id":"d","status":7}')], "source_line long, line string")
    at = records.inferred_fields(lines, ("id", "output", "expected"))
    assert at == {"id": "/record_id", "output": "/prediction", "expected": "/expected"}
    good, bad = records.mapped_outputs(lines, at["id"], at["output"], {"latency_ms": "/t", "error": "/why"})
    assert [(r.case_id, r.raw_output, r.error_kind, r.error_message, r.latency_ms) for r in good.orderBy("source_line").collect()] == [
        ("a", '{"x":1.0}', None, None, 5), ("b", None, "recorded_error", 'Recorded error: {"code":1}', None), ("c", "text", None, None, None),
    ]
    assert sorted((r.source_line, r.violation) for r in bad.collect()) == [(4, "bad_id"), (5, "malformed_json"), (6, "bad_status")]
    assert [records.format_of(n, h) for n, h in (("a.ndjson", ""), ("x", " [1]"), ("x", '{"a":1}'), ("x", "a,b"), ("b.CSV", "{"))] == ["jsonl", "json", "jsonl", "csv", "csv"]


def test_labels_and_pages(spark):
    shown = lambda t, f: one(spark, lambda a, b: outcomes.display(a, b == "y"), t, f)
    assert [shown(t, f) for t, f in (("true", "y"), ("true", "n"), ("false", "y"), ("error", "n"), ("not_applicable", "n"), (None, "n"))] == ["Correct", "Incomplete", "Wrong", "Evaluation error", "N/A", "Unscored"]
    rows = spark.createDataFrame([(str(i), i, ["regressions"] if i % 2 else [], f"word{i % 3}") for i in range(20)], "case_id string, k long, filters array<string>, search_text string")
    page = review.case_page(rows, "k", name="regressions", query="WORD1", limit=2, offset=1)
    assert sorted((r.k, r.total) for r in page.collect()) == [(7, 4), (13, 4)]
    assert review.case_page(rows, "k", name="no such", limit=50).count() == 20 and review.case_page(rows, "k", name="regressions", query="nothing").count() == 0
    match = lambda p, x: one(spark, review.matches, p, x)
    assert match("/a/*/b", "/a/0/b") and not match("/a/*", "/a/0/b") and not match("/a/*/b", "/a/0/c")


def test_configured_runs(spark):
    text = {"version": 1, "evaluators": [{"id": "x", "kind": "exact", "pointers": ["/x"]}], "schema": {"required": ["x"]}, "gate": {"limits": {"max_error_rate": 0.5}}, "bootstrap": {"samples": 200}}
    cases = spark.createDataFrame([("a", "1", '{"x":1}'), ("b", "2", '{"x":2}')], "id string, input string, expected string")
    outs = lambda *rows: spark.createDataFrame(list(rows), "case_id string, status string, error_kind string, raw_output string")
    good, half = outs(("a", "ok", None, '{"x":1}'), ("b", "ok", None, '{"x":2}')), outs(("a", "ok", None, '{"x":1}'), ("b", "ok", None, "{}"))
    made = config.run(cases, good, half, config.loaded(json.dumps(text)))
    p = made["primary"].first()
    assert (p.both_pass, p.baseline_only) == (1, 1) and {r.variant: r.schema_valid for r in made["summary"].collect()} == {"baseline": 2, "candidate": 1}
    assert {r.rule: r.status for r in made["gate"].collect()}["max_error_rate"] == "passed" and made["decision"].count() == 1
    with pytest.raises(ValueError, match="can't be judged"):
        config.run(cases.withColumn("expected", F.lit("{}")), good, half, config.loaded(json.dumps(text)))
    rule = lambda **more: {"evaluators": [{"id": "x", "kind": "exact", "pointers": ["/x"]} | more]}
    for more in (
        {"version": 2}, {"what": 1}, {"gate": {"limits": {"nothing": 1}}}, {"gate": {"limits": {"max_error_rate": 2}}}, {"gate": {"mode": "release", "limits": {}}}, {"bootstrap": {"samples": 1}},
        {"evidence_unit": {"pointer": "/x", "include": ["/y"]}}, {"schema": {"if": {}}},
        # Values of other types.
        {"version": "1"}, {"bootstrap": {"samples": "100"}}, {"bootstrap": {"samples": 100.5}}, {"bootstrap": {"seed": -1}}, {"bootstrap": []}, {"gate": {"limits": {"min_cases": "5"}}}, {"gate": {"limits": []}}, {"gate": {"mode": True}},
        {"evaluators": {}}, {"evaluators": [1]}, {"evaluators": [{"kind": "exact", "pointers": ["/x"]}]}, {"evaluators": [{"id": "x", "pointers": ["/x"]}]}, rule(id=1), rule(kind=["exact"]), rule(pointers="/x"), rule(pointers=[1]),
        rule(expected=[None]), rule(options=[]), rule(kind="canonical_date", options={"formats": "iso"}), rule(kind="decimal", options={"absolute": []}), rule(kind="decimal", options={"absolute": "-1"}),
        rule(kind="normalized_string", options={"case_insensitive": "yes"}), rule(kind="keyed_array", options={"keys": ["/a"], "fields": {}}), rule(kind="keyed_array", options={"keys": {"/a": "exact"}, "fields": {"/b": "exact"}}),
        rule(kind="keyed_array", options={"keys": {"/a": "exact"}, "fields": {"/b": [1]}}), {"primary": "x"}, {"primary": [1]}, {"types": {"/x": 1}}, {"types": []}, {"schema": "x"}, {"schema_provenance": "guessed"}, {"outcome": 1},
        {"evidence_unit": {"pointer": 1}}, {"evidence_unit": {"include": "/x"}}, {"evidence_unit": {"include": [1]}},
    ):
        with pytest.raises(ValueError):
            config.loaded(json.dumps(text | more))
    for wrong in ("", "[]", "{", '{"version": 1}', '{"version": 1, "evaluators": []}'):
        with pytest.raises(ValueError):
            config.loaded(wrong)


def test_modes_of_a_gate():
    """Regression gates need safeguards and a relative rule; release gates keep to the safe profile and have their own schema."""
    plan = Evaluation((("x", "/x", "exact"),), schema='{"required":["x"]}')
    made = lambda mode, limits, **more: config.Config(more.pop("plan", plan), limits, mode, **more)
    guards = {k: gate.PROFILE[k] for k in gate.SAFEGUARDS}
    assert len(guards) == 7
    with pytest.raises(ValueError, match="needs one of"):
        made("regression", guards)
    for name in gate.RELATIVE:
        assert made("regression", guards | {name: 1.0}).mode == "regression"
    for name in guards:
        with pytest.raises(ValueError, match=name):
            made("regression", {k: v for k, v in guards.items() if k != name} | {"max_primary_regression_pp": 1.0})
    assert made("regression", dict.fromkeys(guards, 0) | {"max_primary_regression_pp": 100.0}).limits["min_cases"] == 0
    assert made("advisory", {}).mode == "advisory" and made("release", gate.PROFILE).mode == "release"
    assert made("release", gate.PROFILE | {"min_cases": 5000, "max_deployment_regression_pp": 0}).mode == "release"
    with pytest.raises(ValueError, match="safe release profile"):  # no floor under the candidate
        made("release", guards | {"max_deployment_regression_pp": 1.0})
    vacuous = {k: (1 if k.endswith("cases") else 0) if k.startswith("min") else 100 if k.endswith("pp") else 1 for k in gate.PROFILE}
    with pytest.raises(ValueError, match="safe release profile"):
        made("release", vacuous)
    for name, bound in gate.PROFILE.items():
        for limits in ({k: v for k, v in gate.PROFILE.items() if k != name}, gate.PROFILE | {name: bound * 0.9 if name.startswith("min") else bound + 0.01}):
            with pytest.raises(ValueError, match=name):
                made("release", limits)
    with pytest.raises(ValueError, match="own schema"):
        made("release", gate.PROFILE, inferred=True)
    with pytest.raises(ValueError, match="own schema"):
        made("release", gate.PROFILE, plan=Evaluation((("x", "/x", "exact"),)))
    for limits in ({"min_cases": float("nan")}, {"min_cases": float("inf")}, {"min_cases": True}, {"min_cases": -1}, {"max_error_rate": 1.01}):
        with pytest.raises(ValueError, match="out of range"):
            made("advisory", limits)


def test_ids_that_a_run_refuses(spark):
    text = {"version": 1, "evaluators": [{"id": "x", "kind": "exact", "pointers": ["/x"]}]}
    cases = spark.createDataFrame([("a", "1", '{"x":1}'), ("b", "2", '{"x":2}')], "id string, input string, expected string")
    outs = lambda *ids: spark.createDataFrame([(i, "ok", None, '{"x":1}') for i in ids], "case_id string, status string, error_kind string, raw_output string")
    found = lambda c, b, o: sorted(map(tuple, config.id_faults(c, {"baseline": b, "candidate": o}).collect()), key=str)
    assert found(cases, outs("a"), outs("b", "a")) == [] and found(cases, outs(), outs()) == []
    assert found(cases, outs("a", "a"), outs("z", None)) == [("a", "baseline", "repeated"), ("z", "candidate", "unknown"), (None, "candidate", "null")]
    assert found(cases.union(cases.limit(1)), outs("z", "z"), outs()) == [("a", "cases", "repeated"), ("z", "baseline", "repeated"), ("z", "baseline", "unknown")]
    for wrong in ((cases, outs("a", "a"), outs("b")), (cases, outs("a"), outs("z")), (cases.union(cases), outs("a"), outs("b"))):
        with pytest.raises(ValueError, match="ids that can't be taken"):
            config.run(*wrong, config.loaded(json.dumps(text)))


def test_outputs_of_several_files(spark, tmp_path):
    """One id on the same line of two files: the first by file stays, the other is told."""
    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.jsonl").write_text(f'{{"case_id":"x","raw_output":"{value}"}}\n{{"case_id":"{name}","raw_output":"3"}}\n')
    known = spark.createDataFrame([("x",), ("a",), ("b",)], "id string")
    kept, broken = records.outputs(records.json_lines(spark, str(tmp_path)), known)
    assert sorted((r.case_id, r.raw_output) for r in kept.collect()) == [("a", "3"), ("b", "3"), ("x", "1")]
    assert [(r.source_line, r.case_id, r.violation) for r in broken.collect()] == [(1, "x", "duplicate_id")]


def test_digests_of_lists_that_read_alike(spark):
    df = spark.createDataFrame([("a\0vb", "c"), ("a", "b\0vc"), ("a1:b", ""), ("a", "b"), (None, "n"), ("n", None), ("", None), (None, "")], "x string, y string")
    assert df.select(evidence.digest(F.col("x"), F.col("y")).alias("d")).distinct().count() == 8


def test_malformed_texts_don_t_stop_a_job(spark):
    from pairwright.functions.json import diff, json_items, redact

    assert one(spark, diff, "{", "1") is None and one(spark, diff, None, "1") == [] and one(spark, lambda c: redact(c, ["/a"]), '{"a":1') is None
    assert one(spark, json_items, "[1,") is None and one(spark, json_items, None) is None and one(spark, json_items, "[1, 2]") == ["1", "2"]
