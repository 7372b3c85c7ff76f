"""How often things are done: what a query reads and parses once must not be done again by everything that follows."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from pairwright.functions import schema as S
from pairwright.functions.json import Number, canonical, each, parse, records, resolve
from pairwright.operators import caseindex, discovery, evidence, gate
from pairwright.operators import evaluators as E
from pairwright.plans import config, queries
from pairwright.plans.reuse import _order_inputs

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_is_evaluated_once(spark):
    """Everything that a run gives reads the written evaluations; none of it parses outputs again."""
    made = config.run(*_order_inputs(spark, SF))
    for name, df in made.items():
        assert "Relation" in _plan(df) and "o_orderkey" not in _plan(df), name
    assert made["evaluations"].count() == 2 * spark.read.parquet(f"{SF}/orders.parquet").count()


def test_units_are_read_once_and_after_dealing(spark):
    """A filter on what was read neither reads again nor moves before the cases are dealt out."""
    cases, base, cand, chosen = _order_inputs(spark, SF)
    plan = _plan(config.evaluations(cases, base, cand, chosen))
    assert plan.count("ArrowEvalPython") <= 3 and "RepartitionByExpression" in plan
    found = spark.range(10).select(F.col("id").cast("string").alias("t")).repartition(3, "t").withColumn("u", each(lambda x: x, "string", F.col("t"), once=True)).where("u <> '3'")
    assert _plan(found).index("Filter") < _plan(found).index("RepartitionByExpression") and found.count() == 9


def test_canonical_texts_and_pointers():
    text = '{"b~/":[1,-2.50,{"\\u00e9\\n":null}],"a":true,"0":[[]]}'
    assert canonical(parse(text)) == '{"0":[[]],"a":true,"b~/":[1,-2.50,{"é\\n":null}]}'
    assert resolve(parse(text), "/b~0~1/1") == "-2.50" and resolve(parse(text), "/0/0") == []
    assert all(resolve(parse(text), p) is ... for p in ("/b~0~1/01", "/b~0~1/-1", "/b~0~1/9", "/0/x", "/b~0~1/" + "9" * 30))


def test_documents_are_surveyed_once_in_a_few_rows(spark):
    """What a task gives grows with places, not with documents, and all that is proposed comes from one reading."""
    docs = spark.range(0, 3000, numPartitions=2).select(F.concat(F.lit('{"a":"2024-01-0'), F.col("id") % 9 + 1, F.lit('","b":"'), F.col("id"), F.lit('.5","l":[{"k":'), F.col("id"), F.lit('},{"k":"'), F.col("id"), F.lit('"}]}')).alias("doc"))
    found = discovery.survey(docs, "doc")
    assert found.count() == 2 * 7
    assert {r.place: r.suggested for r in discovery.likeness(found).collect()} == {"/a": "canonical_date", "/b": "decimal_exact"}
    members = {(m.place, m.member): (m.arrays, m.whole, m.unique, m.several) for m in discovery.array_members(docs, "doc", found).collect()}
    assert members == {("/l", "k"): (3000, 3000, 3000, 3000)}
    assert "MapInArrow" not in _plan(discovery.places(docs, "doc"))


def test_a_survey_that_begins_anew_gives_the_same(spark, monkeypatch):
    docs = spark.range(0, 40, numPartitions=1).select(F.concat(F.lit('{"k'), F.col("id") % 7, F.lit('":[1,{"x":null}]}')).alias("doc"))
    whole = sorted(discovery.places(docs, "doc").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        monkeypatch.setattr(discovery, "HELD", 5)
        found = discovery.survey(docs, "doc")
        assert found.count() > len(whole) and sorted(discovery.places(docs, "doc", found).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prepared_checks_give_the_errors_of_the_walk():
    rules = {"type": "object", "required": ["a", "b/"], "properties": {"a": {"type": ["integer", "null"]}, "b/": {"type": "array", "items": {"type": "number", "minimum": Number("2")}}, "c": True, "d": False}, "additionalProperties": False}
    for value in ({}, [], None, {"a": Number("1.0"), "b/": []}, {"a": Number("1.5"), "b/": [Number("1"), Number("2"), "x"], "c": 1, "d": None, "e~": {}}, {"a": None, "b/": {}}, {"a": True, "b/": [True]}):
        for r in (rules, rules | {"additionalProperties": {"type": "string"}}, {"type": "object", "properties": {"x": rules}}, True, False, {}):
            out: list = []
            S._checker(r, r)(value, "", out)
            assert sorted(set(out)) == sorted(set(S._errors(value, r, r, "", 0))), (value, r)


def _slow_status(e, a, keys, comparisons):
    """Of items as records give them, the status by its definition."""
    def name(item):
        parts = [x and (x["json"] if how == "exact" else x["norm"] and x["norm"].lower()) for x, how in zip(item, keys, strict=False)]
        return None if None in parts or "null" in parts else tuple(parts)

    bad = lambda items: None in (n := [name(x) for x in items]) or len(set(n)) < len(n)
    if e is None or bad(e):
        return "error"
    there = {}
    for x in reversed(a or []):
        there[name(x)] = x
    there.pop(None, None)
    states = []
    for x in e:
        if (o := there.get(name(x))) is not None:
            for n in range(len(comparisons)):
                v, w = x[len(keys) + n], o[len(keys) + n]
                states.append("error" if v is None else "failed" if w is None else "passed" if v["json"] == w["json"] else "failed")
    if "error" in states:
        return "error"
    if a is None or bad(a):
        return "failed"
    return "passed" if "failed" not in states and {name(x) for x in e} == {name(x) for x in a} else "failed"


def test_keyed_items_by_their_definition(spark):
    """Random arrays: keys that lack, are null or repeat, items that lack or are more, fields that lack or differ."""
    r = random.Random(5)
    item = lambda: {k: v for k, v in (("k", r.choice([1, 2, 3, "3", None])), ("n", r.choice(["A", "a", "b"])), ("v", r.choice([1, 1, 1, 2])), ("w", 1)) if r.random() < 0.97}
    whole = lambda: [{"k": i, "n": "a", "v": 1, "w": 1} for i in range(r.randrange(4))]
    rows = []
    for _ in range(400):
        e = r.choice([whole(), [item() for _ in range(r.randrange(4))], 7])
        a = r.choice([e, list(reversed(e)) if isinstance(e, list) else e, whole(), [item() for _ in range(r.randrange(4))], None])
        rows.append((json.dumps(e), json.dumps(a)))
    keys, comparisons = ("exact", "normalized_string"), (("exact", {}), ("exact", {}))
    df = spark.createDataFrame(rows, "e string, a string").select(*(records(F.col(c), ["/k", "/n", "/v", "/w"]).alias(c) for c in "ea"))
    found = df.select("e", "a", E.keyed_status(F.col("e"), F.col("a"), keys, comparisons).alias("s"), E.keyed_records(F.col("e"), F.col("a"), keys, comparisons).alias("r")).collect()
    for x in found:
        assert x.s == x.r.status == _slow_status(x.e, x.a, keys, comparisons), x
    assert {x.s for x in found} == {"passed", "failed", "error"}


def test_lists_of_an_index_are_gathered_in_the_task(spark, tmp_path, monkeypatch):
    """A run gives a row for each block and task, not for each text; lists given in parts come together."""
    texts = spark.range(0, 300, numPartitions=1).select((F.col("id") / 100).cast("long").alias("block"), (F.col("id") % 100).cast("int").alias("place"), F.concat(F.lit("abc"), F.col("id") % 2).alias("text"))
    found = caseindex._postings(texts)
    assert found.count() == 3 * 7  # abc, and bc, c and the end with each digit
    cases = texts.select((F.col("block") * 100 + F.col("place")).alias("ordinal"), (F.col("block") * 100 + F.col("place")).cast("string").alias("case_id"), F.col("text").alias("search_text"))
    monkeypatch.setattr(caseindex, "HELD", 10)
    assert caseindex._postings(texts).count() > 21
    caseindex.build(cases, str(tmp_path / "index"))
    assert sorted(int(r.case_id) for r in caseindex.search(spark, str(tmp_path / "index"), "BC1").collect()) == list(range(1, 300, 2))
    assert caseindex.search(spark, str(tmp_path / "index"), "c").count() == 300


def test_a_gate_shuffles_no_texts(spark, monkeypatch):
    """Outputs, references and what was observed become hashes before rows are paired, and a unit's row doesn't hold its keys again."""
    asked: dict = {}
    monkeypatch.setattr(gate, "inputs", lambda pairs, **more: asked.update(more) or pairs)
    kinds = {f.name: f.dataType.simpleString() for f in queries._gate_inputs(queries._faulty(spark, SF)).schema["baseline"].dataType}
    read = str(asked["observation"]) + str(asked["reference"])
    assert "seen" in read and "reference" in read and not any(x in read for x in ("output", "expected", "tokens", "components"))
    assert kinds["seen"] == kinds["reference"] == "binary"
    rows = spark.range(6).select(F.col("id"), (F.col("id") % 2).alias("u"), F.lit(1).alias("seen"), F.lit("t").alias("text"))
    found = evidence.represented(rows, evidence.hashed(F.col("u")), F.col("seen"), "id", ("id",))
    assert found.schema["row"].dataType.names == ["id"] and sorted((r.row.id, r.rows, r.kind) for r in found.collect()) == [(0, 3, "exact_duplicate"), (1, 3, "exact_duplicate")]
