"""Schemas, keys and configurations from all documents of a column."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions.schema import schema_errors
from pairwright.operators import discovery
from pairwright.plans import proposal
from pairwright.plans.config import loaded
from pairwright.plans.paired import evaluate_all, reference_issues


def frame(spark, *values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values], "doc string").repartition(3)


def random_value(r, depth):
    kind = r.randrange(8 if depth else 5)
    if kind < 5:
        return r.choice([1, -2, "a", "", None, True, 1.5, "2024-01-01"])
    if kind < 7:
        return {k: random_value(r, depth - 1) for k in r.sample(["a", "b", "c/d", "~", "*", "~2"], r.randrange(4))}
    return [random_value(r, depth - 1) for _ in range(r.randrange(4))]


def test_a_schema_takes_every_row_it_came_from(spark):
    for seed in range(6):
        r = random.Random(seed)
        docs = frame(spark, *([random_value(r, 3) for _ in range(40)] + ["{", None, ""]))
        schema = discovery.discovered_schema(docs, "doc")
        wrong = docs.select("doc", schema_errors(F.col("doc"), schema).alias("e")).where("size(e) > 0").collect()
        assert wrong == [], (seed, wrong[:2])


def test_types_and_presence(spark):
    docs = frame(spark, {"a": 1, "b": {"x": 1}, "l": [1, 2]}, {"a": 1.5, "b": {"x": "t", "y": None}, "l": []}, {"a": 2, "b": 7, "*": True}, "[", None)
    found = {p.place: (p.t, p.n, p.required) for p in discovery.places(docs, "doc").withColumn("t", discovery.type_names(F.col("types"))).collect()}
    assert found == {
        "": (["object"], 3, None), "/a": (["number"], 3, True), "/b": (["integer", "object"], 3, True), "/b/x": (["integer", "string"], 2, True), "/b/y": (["null"], 1, False), "/l": (["array"], 2, False),
        "/l/*": (["integer"], 2, None), "/~2": (["boolean"], 1, False),
    }
    schema = json.loads(discovery.discovered_schema(docs, "doc"))
    assert schema["required"] == ["a", "b"] and schema["properties"]["b"] == {"type": ["integer", "object"], "properties": {"x": {"type": ["integer", "string"]}, "y": {"type": "null"}}, "required": ["x"], "additionalProperties": False}
    assert set(schema["properties"]) == {"a", "b", "l", "*"} and schema["properties"]["l"] == {"type": "array", "items": {"type": "integer"}}
    assert discovery.discovered_schema(docs.limit(0), "doc") == "{}" and discovery.discovered_schema(frame(spark, [1], []), "doc") == '{"type": "array", "items": {"type": "integer"}}'


def test_documents_whose_keys_are_data(spark, monkeypatch):
    monkeypatch.setattr(discovery, "MOST_PLACES", 50)
    with pytest.raises(ValueError, match="keys are data"):
        discovery.discovered_schema(frame(spark, *({f"k{i}": 1} for i in range(60))), "doc")


def test_keys_of_arrays(spark):
    """Decoys: a member that repeats in one array, one that an item lacks, one that a whole array lacks, one of mixed kinds, one never put to the test."""
    item = lambda n, **more: {"n": n, "kind": "x", **more}
    docs = frame(
        spark, {"rows": [item(1, code="a", id="1"), item(2, code="b", id="2")], "deep": [{"in": [{"k": 1}, {"k": 2}]}, {"in": [{"k": 1}]}]}, {"rows": [item(5, code="a", id="1"), item(6, code="c", id="1")]},
        {"rows": [item(7, code="q", id="9")]}, {"rows": [item(8, id="3"), item(9, id="4")]}, {"rows": []}, {"one": [{"z": 1}]}, {"mixed": [{"m": 1, "o": "a"}, {"m": {}, "o": "b"}]}, {"plain": [1, 2]},
    )
    found = discovery.places(docs, "doc")
    keys = {k.place: k.key for k in discovery.array_keys(discovery.array_members(docs, "doc"), found).collect()}
    assert keys == {"/rows": "n", "/deep/*/in": "k", "/mixed": "o"}
    members = {(m.place, m.member): (m.arrays, m.whole, m.unique, m.several) for m in discovery.array_members(docs, "doc").collect()}
    assert members["/rows", "id"] == (4, 4, 3, 3) and members["/rows", "code"] == (3, 3, 3, 2) and members["/rows", "kind"] == (4, 4, 1, 3) and members["/one", "z"] == (1, 1, 1, 0)


def test_proposed_configurations(spark):
    docs = [{"total": f"{i}.50", "day": f"2024-01-{i + 1:02}", "n": i, "name": f"N {i}", "ok": True, "maybe": 1, "odd": i if i % 2 else "x", "in": {"deep": 1.5}, "lines": [{"sku": f"s{j}", "qty": j, "text": "t"} for j in range(i + 1)], "tags": ["a"]} for i in range(5)]
    del docs[2]["maybe"]
    docs[3]["day"] = "2024-02-31"  # looks like a date and is none
    cases = spark.createDataFrame([(str(i), json.dumps(x)) for i, x in enumerate(docs)], "id string, expected string")
    made = loaded(proposal.proposed(cases))
    kinds = {r.id: r.kind for r in made.plan.rules}
    assert kinds == {"day": "exact", "in.deep": "decimal", "lines": "keyed_array", "n": "exact_integer", "name": "normalized_string", "odd": "exact", "ok": "exact", "tags": "exact", "total": "decimal"}
    lines = next(r for r in made.plan.rules if r.id == "lines")
    assert dict(lines.options["keys"]) == {"/sku": "exact"} and {p: how for p, (how, _) in lines.options["fields"].items()} == {"/qty": "exact_integer", "/text": "normalized_string"}
    assert made.inferred and made.mode == "advisory" and reference_issues(cases, made.plan).count() == 0
    out = cases.select(F.col("id").alias("case_id"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_kind"), F.col("expected").alias("raw_output"))
    e = evaluate_all(cases, {"baseline": out}, made.plan)
    assert e.where("truth = 'true' and schema_valid").count() == 5
    for nothing in ("[]", "{}", None):
        with pytest.raises(ValueError, match="nothing can be proposed"):
            proposal.proposed(spark.createDataFrame([("a", nothing)], "id string, expected string"))
