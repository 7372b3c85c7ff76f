"""The case index, evaluations by content, and values inside documents, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions.subtrees import contains, subtrees
from pairwright.operators import caseindex
from pairwright.plans import incremental, preflight
from pairwright.plans.paired import Evaluation, Rule, evaluate_all


def test_searches_by_the_index_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caseindex, "BLOCK", 64)
    r = random.Random(1)
    text = lambda: "".join(r.choice(["ab", "Ab", "c", "ÄÖ", " ", "%", "_", "😀", "aaa", "x\n"]) for _ in range(r.randrange(0, 25)))
    rows = [(f"c{i}", i * 3, text()) for i in range(500)] + [("null", 2000, None), ("empty", 2001, ""), ("a", 2002, "a"), ("same", 2003, "zzz"), ("long", 2004, "abc" * 30_000 + "zzq")]
    path = str(tmp_path / "index")
    caseindex.build(spark.createDataFrame(rows, "case_id string, ordinal long, search_text string").repartition(4), path)
    for q in ("", "a", "ab", "AB", "abc", "aba", "äö", "ä", "😀", "😀 ", "%", "_%", "aaaa", "x\n", "\n", "zzz", "zzq", "cabcabz", "nothing here", "ab" * 60, "aaaaaaaaaaaaaaaaaaaaaaa"):
        got = sorted(x.case_id for x in caseindex.search(spark, path, q).collect())
        assert got == sorted(i for i, _, t in rows if q.lower() in (t or "").lower()), q
    with pytest.raises(ValueError):
        caseindex.search(spark, path, "x" * 257)


def test_a_search_reads_its_own_postings(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(str(i), i, f"word{i} and more {i * 7919}") for i in range(3000)]
    caseindex.build(spark.createDataFrame(rows, "case_id string, ordinal long, search_text string"), path)
    found = caseindex.candidates(spark, path, "word2999")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan


PLAN = Evaluation((Rule("x", "decimal", ("/x",), options={"absolute": "0.5"}), ("y", "/y", "exact")), (("/y", "string"),), schema='{"required":["x"]}')


def tables(spark, changed=()):
    cases = [(f"c{i}", json.dumps({"x": i, "y": str(i % 3)})) for i in range(60)] + [("lost", None)]
    out = [(f"c{i}", "ok", None, json.dumps({"x": i + (1 if i % 5 == 0 else 0), "y": "changed" if i in changed else str(i % 3)}), i) for i in range(55)] + [("c55", "ok", None, "{", 1), ("c56", "error", "timeout", None, 2)]
    return spark.createDataFrame(cases, "id string, expected string"), spark.createDataFrame(out, "case_id string, status string, error_kind string, raw_output string, latency_ms long")


def seen(df):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.asDict().items() if k not in ("reused", "_e"))) for r in df.collect()))


def test_what_is_reused_is_what_scoring_gives(spark):
    cases, out = tables(spark)
    one, made = incremental.evaluate_again(cases, {"baseline": out, "candidate": out}, PLAN, None)
    assert seen(one) == seen(evaluate_all(cases, {"baseline": out, "candidate": out}, PLAN)) and one.where("reused").count() == 0
    stored = spark.createDataFrame(made.collect(), made.schema)
    assert stored.count() < one.count() and stored.select("content").distinct().count() == stored.count()
    two, more = incremental.evaluate_again(cases, {"baseline": out, "candidate": out}, PLAN, stored)
    assert seen(two) == seen(one) and two.where("not reused").count() == 0 and more.count() == 0
    cases, other = tables(spark, changed={3, 40})
    three, more = incremental.evaluate_again(cases, {"baseline": out, "candidate": other}, PLAN, stored)
    assert seen(three) == seen(evaluate_all(cases, {"baseline": out, "candidate": other}, PLAN))
    assert sorted((r.case_id, r.variant) for r in three.where("not reused").collect()) == [("c3", "candidate"), ("c40", "candidate")] and more.count() == 2
    # An interrupted run goes on from what it had stored.
    part = spark.createDataFrame(stored.orderBy("content").limit(20).collect(), stored.schema)
    four, rest = incremental.evaluate_again(cases, {"baseline": out, "candidate": out}, PLAN, part.union(part))
    assert seen(four) == seen(one) and rest.count() == stored.count() - 20
    # Another plan reuses nothing.
    for changed in (Evaluation(PLAN.evaluators[:1]), Evaluation((Rule("x", "decimal", ("/x",), options={"absolute": "0.4"}), PLAN.evaluators[1]), PLAN.types, schema=PLAN.schema)):
        assert incremental.fingerprint(changed) != incremental.fingerprint(PLAN)
        assert incremental.evaluate_again(cases, {"baseline": out}, changed, stored)[0].where("reused").count() == 0
    same = Evaluation((Rule("x", "keyed_array", ("/x",), options={"keys": {"/a": "exact"}, "fields": {"/b": ("exact", {})}}),))
    turned = Evaluation((Rule("x", "keyed_array", ("/x",), options={"fields": {"/b": ("exact", {})}, "keys": {"/a": "exact"}}),))
    assert incremental.fingerprint(same) == incremental.fingerprint(turned)
    with pytest.raises(ValueError):
        incremental.evaluate_again(cases, {"baseline": out}, Evaluation((Rule("e", "external"),)), None)


def random_value(r, depth):
    kind = r.randrange(7 if depth else 4)
    if kind < 4:
        return r.choice([1, 2, "a", "1", None, True, False, "~/", 1.5])
    if kind < 6:
        return {r.choice(["a", "b", "c/d", "~"]): random_value(r, depth - 1) for _ in range(r.randrange(3))}
    return [random_value(r, depth - 1) for _ in range(r.randrange(3))]


def stands_in(document, value):
    if type(document) is type(value) and document == value and json.dumps(document, sort_keys=True) == json.dumps(value, sort_keys=True):
        return True
    inner = document.values() if isinstance(document, dict) else document if isinstance(document, list) else ()
    return any(stands_in(x, value) for x in inner)


def every_value(value, path=""):
    yield path, value
    for step, x in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from every_value(x, f"{path}/{str(step).replace('~', '~0').replace('/', '~1')}")


def test_containment_by_brute_force(spark):
    r = random.Random(7)
    pairs = [(i, random_value(r, 4), random_value(r, 2)) for i in range(600)]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    got = {x.i: x.c for x in df.select("i", contains(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {i: stands_in(a, b) for i, a, b in pairs} and sum(got.values()) > 40
    cases = df.select(F.col("i").cast("string").alias("id"), F.col("a").alias("input"), F.col("b").alias("expected"))
    held = {int(x.id): sorted(x.held) for x in preflight.held_values(cases).collect()}
    for i, a, b in pairs:
        found = [p for p, v in every_value(b) if v not in (None, {}, []) and stands_in(a, v)]
        assert held[i] == sorted(p for p in found if not any(q != p and p.startswith(f"{q}/") for q in found)), (a, b)


def test_trees_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ('{"a":1,"a":2}',), ("[" * 5000,), (' {"b":1.0,"a":[1]} ',), ('{"a":[1],"b":1.0}',), ('{"a":[1],"b":1}',)], "t string")
    trees = [r.x for r in df.select(subtrees(F.col("t")).alias("x")).collect()]
    assert trees[:5] == [[]] * 5 and trees[5][-1].hash == trees[6][-1].hash != trees[7][-1].hash
    assert [x.pointer for x in trees[6]] == ["/a/0", "/a", "/b", ""]
    assert [r.c for r in df.select(contains(F.col("t"), F.lit("1")).alias("c")).collect()] == [None] * 5 + [True] * 3
