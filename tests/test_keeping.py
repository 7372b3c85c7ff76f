"""Prompts, settings, staged files and retained outputs on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions.prompt import holes, prompt
from pairwright.operators import provenance
from pairwright.plans import retention
from pairwright.plans.paired import Evaluation, Rule, evaluate_all
from pairwright.sources import staged


def test_prompts(spark):
    rows = [('{"a":{"b":["x",{"c":1.50}]},"n":null}', '{"s":"t"}'), ('{"a":{"b":[]}}', '{"s":"t"}'), ("{", "{}"), (None, None)]
    df = spark.createDataFrame(rows, "input string, model_visible_metadata string").coalesce(1)
    shown = lambda t: [tuple(r.p) for r in df.select(prompt(t).alias("p")).collect()]
    assert shown("{{ input.a.b[0] }}-{{input.a.b[1].c}}{{ model_visible_metadata.s }}{{ input.a.b[0] }}!") == [("x-1.50tx!", None), (None, "input/a/b/0"), (None, "input/a/b/0"), (None, "input/a/b/0")]
    assert shown("{{ input.n }}")[0] == ("null", None) and shown("{{ input }}")[0][0] == '{"a":{"b":["x",{"c":1.50}]},"n":null}'
    assert shown("no holes { } %s") == [("no holes { } %s", None)] * 4
    assert holes("{{ input.a }} {{model_visible_metadata}}") == [("input", "/a"), ("model_visible_metadata", "")]
    for bad in ("{{ expected.a }}", "{{ metadata }}", "{{ id }}", "{{ input.a() }}", "{{ input | upper }}", "{{ 1 }}", "{{ }}", "{{ input.a", "input.a }}", "{{ input..a }}", "{{ input[-1] }}", "{% for x in input %}{{ x }}"):
        with pytest.raises(ValueError):
            prompt(bad)


def test_settings_and_their_sources(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "k int, text string").coalesce(1)
    base = provenance.settings(table((1, '{"a":{"b":1,"c":[]},"d":null,"e":{}}'), (2, '{"a":1}')), "k", "text")
    assert sorted(map(tuple, base.collect())) == [(1, "/a/b", "1"), (1, "/a/c", "[]"), (1, "/d", "null"), (1, "/e", "{}"), (2, "/a", "1")]
    more = provenance.settings(table((1, '{"a":{"b":2},"d":null,"x":"y"}')), "k", "text")
    found = {(r.k, r.pointer): (r.value, r.replaced, r.source) for r in provenance.overridden(base, more, "k").collect()}
    assert found == {
        (1, "/a/b"): ("2", "1", "override"), (1, "/a/c"): ("[]", "[]", "configuration"), (1, "/d"): ("null", "null", "configuration"), (1, "/e"): ("{}", "{}", "configuration"), (1, "/x"): ('"y"', None, "added"),
        (2, "/a"): ("1", "1", "configuration"),
    }
    told = provenance.settings(table((1, '{"a":{"b":1.0,"c":[]},"e":{}}'), (2, '{"a":1,"ab":2}')), "k", "text")
    wrong = lambda **more: sorted((r.k, r.pointer, r.manifest, r.configuration) for r in provenance.disagreements(told, base, "k", **more).collect())
    assert wrong() == [(1, "/a/b", "1.0", "1"), (1, "/d", None, "null"), (2, "/ab", "2", None)] and wrong(fields=("/a",)) == [(1, "/a/b", "1.0", "1")]


def test_one_flipped_byte_is_named(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "a.bin").write_bytes(bytes(range(256)) * 20)
    (root / "deep" / "b.bin").write_bytes(b"x" * 3000)
    (root / "empty").write_bytes(b"")
    known = spark.createDataFrame(staged.parts(spark, str(root), size=1000).collect(), "file string, part int, bytes long, digest string")
    assert {r.file: (r.parts, r.bytes) for r in staged.files(known).collect()} == {"a.bin": (6, 5120), "deep/b.bin": (3, 3000)}
    assert staged.verified(spark, str(root), known, size=1000) == str(root)
    name = staged.address(known)
    data = bytearray((root / "a.bin").read_bytes())
    data[2345] ^= 1
    (root / "a.bin").write_bytes(bytes(data))
    (root / "new").write_bytes(b"1")
    (root / "deep" / "b.bin").write_bytes(b"x" * 2000)
    assert sorted(map(tuple, staged.faults(spark, str(root), known, size=1000).collect())) == [("a.bin", 2, "changed"), ("deep/b.bin", 2, "lost"), ("new", 0, "new")]
    with pytest.raises(ValueError, match="a.bin"):
        staged.verified(spark, str(root), known, size=1000)
    assert staged.address(staged.parts(spark, str(root), size=1000)) != name and staged.address(known.orderBy(F.desc("digest"))) == name
    other = tmp_path / "copy"
    (other / "deep").mkdir(parents=True)
    for f in ("a.bin", "deep/b.bin", "empty"):
        (other / f).write_bytes({"a.bin": bytes(range(256)) * 20, "deep/b.bin": b"x" * 3000, "empty": b""}[f])
    assert staged.address(staged.parts(spark, str(other), size=1000)) == name  # known by what it holds, not by where it lies


PLAN = Evaluation(
    (
        Rule("total", "decimal", ("/total",)), Rule("who", "normalized_string", ("/party/name",)), Rule("rows", "keyed_array", ("/rows",), options={"keys": {"/sku": "exact"}, "fields": {"/n/m": ("exact", {})}}),
        Rule("first", "exact", ("/rows/0/sku",)), Rule("needed", "required_fields", ("/total", "/gone")),
    ), (("/flag", "boolean"),), primary=("total", "who", "rows"), schema='{"required":["secret"],"properties":{"secret":{"minLength":3}}}',
)


def test_retained_outputs_replay_alike(spark):
    doc = lambda **more: json.dumps({"total": "1.0", "party": {"name": " A  b", "iban": "DE00"}, "rows": [{"sku": "x", "n": {"m": 1, "p": "q"}}, {"sku": "y", "n": {"m": 2}}], "flag": True, "secret": "s3cret", "gone": 1} | more)
    raws = [doc(), doc(total="2"), doc(secret="s"), doc(rows=[{"sku": "y", "n": {"m": 2}}, {"sku": "x", "n": {"m": 9}}]), doc(rows=[]), doc(rows=["s3cret"]), doc(rows={"0": {"sku": "x"}}), doc(party=7), doc(flag="s3cret"), "s3cret", '{"a":1,"a":2}', " [1] ", None]
    cases = spark.createDataFrame([(str(i), doc()) for i in range(len(raws))] + [("lost", doc())], "id string, expected string").coalesce(1)
    meta = json.dumps({"id": "req-1", "messages": ["s3cret"], "model": "m"})
    out = spark.createDataFrame([(str(i), "ok" if x is not None else "error", None if x is not None else "timeout", x, meta if i % 2 else None, i) for i, x in enumerate(raws)], "case_id string, status string, error_kind string, raw_output string, metadata string, latency_ms long").coalesce(1)
    kept = retention.retained(out, PLAN)
    rows = kept.collect()
    assert all(r.raw_output is None or ("DE00" not in r.raw_output and '"p"' not in r.raw_output) for r in rows)
    assert sorted({r.metadata for r in rows if r.metadata}) == ['{"model":"m"}']
    assert [(r.receipt.valid, r.receipt.schema_valid) for r in rows[:3]] == [(True, True), (True, True), (True, False)] and rows[-1].receipt is None and rows[9].receipt.valid is False
    columns = ["case_id", "variant", "status", "parse_valid", "schema_valid", "truth", "fully_evaluated", "semantic_success", "deployment_success", "valid_but_wrong", *(f"{r.id}_state" for r in PLAN.rules)]
    whole = evaluate_all(cases, {"baseline": out}, PLAN).select(*columns)
    again = retention.evaluated(cases, {"baseline": kept}, PLAN).select(*columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    assert retention.under(out, PLAN, "full") is out and retention.under(out, PLAN, "off").where("raw_output is not null").count() == 0
    assert json.loads(retention.manifest("sanitized", PLAN))["kept"][0] == "/flag"
    with pytest.raises(ValueError):
        retention.policy("some")


def test_what_a_system_sees_and_an_error_tells(spark):
    from pairwright.operators import discovery, evidence, pairing, profile

    cases = spark.createDataFrame([("a", "1", "x", "{}", 1), ("b", "1", "y", "{}", 2), ("c", "1", "y", "{}", 3), ("d", "2", "x", "{}", 4)], "id string, input string, expected string, metadata string, source_line int").coalesce(1)
    assert pairing.label_blind(cases).columns == ["id", "input"]
    told = evidence.conflicting_lines(cases, F.col("input"), F.col("expected"), F.col("source_line")).collect()
    assert [tuple(r) for r in told] == [("1", 1, 2)]
    docs = spark.createDataFrame([('{"a|b":[1,"x"]}',), ("{}",)], "doc string")
    assert discovery.markdown(discovery.places(docs, "doc")).split("\n")[2:] == ["| `/` | object | 2 |  |", "| `/a&#124;b` | array | 1 | 2 |", "| `/a&#124;b/*` | integer, string | 2 |  |"]
    schema = {
        "if": {"properties": {"k": {"const": 1}}}, "then": {"properties": {"t": {"type": "string"}}, "required": ["t"]}, "else": {"properties": {"e": {"type": ["null", "integer"]}}},
        "dependentSchemas": {"k": {"properties": {"d": {"type": "array", "prefixItems": [{"type": "string"}, {"type": "object", "properties": {"in": {}}}]}}}},
    }
    assert profile.inspect_schema(schema) == [("/k", "any", False), ("/t", "string", True), ("/e", "null|integer", False), ("/d", "array", False), ("/d/0", "string", False), ("/d/1", "object", False), ("/d/1/in", "any", False)]


def test_caps_on_lines_and_outputs(spark):
    from pairwright.sources import records

    lines = spark.createDataFrame([(1, '{"case_id":"a","raw_output":"' + "x" * 50 + '"}'), (2, '{"case_id":"b","parsed_output":[' + "1," * 30 + "1]}"), (3, '{"case_id":"c","raw_output":"é"}'), (4, '{"case_id":"d","raw_output":"1"' + " " * 300 + "}")], "source_line long, line string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    kept, broken = records.outputs(lines, known, max_line_bytes=200, max_output_bytes=40)
    assert [r.case_id for r in kept.collect()] == ["c"]
    assert sorted((r.source_line, r.violation) for r in broken.collect()) == [(1, "output_too_long"), (2, "output_too_long"), (4, "line_too_long")]


def test_a_run_s_folder_may_be_cleared(spark):
    import shutil

    from pairwright.sources.scratch import shared_path, written

    spark.conf.set("pairwright.run", "run-7")
    try:
        kept = written(spark.range(5).toDF("x"), "numbers")
        folder = shared_path(spark, "x").rpartition("/")[0]
        assert folder.endswith("/run-7") and kept.count() == 5 and "/run-7/numbers-" in kept.inputFiles()[0]
        shutil.rmtree(folder)
    finally:
        spark.conf.unset("pairwright.run")
    assert "/run-7/" not in shared_path(spark, "x")
