import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions.json import redact
from pairwright.operators import gate, review, summary
from pairwright.plans import config
from pairwright.plans.paired import Evaluation, order_evaluations
from pairwright.plans.queries import QUERIES
from pairwright.sources import pins, records, snapshots, store

SF = "/root/testdata/sf0.001"


def test_runs(spark, tmp_path):
    base = str(tmp_path / "runs")
    e = order_evaluations(spark, SF).drop("expected", "raw_output")
    for run, kind in (("01A", "production"), ("01B", "demo"), ("01C", "production")):
        store.write_run(base, run, kind, {"evaluations": e, "summary": summary.variant_summary(e)})
    assert [store.resolve_run(spark, base, s) for s in ("latest", "latest-demo", "latest-any", "01A")] == ["01C", "01B", "01C", "01A"]
    with pytest.raises(LookupError):
        store.resolve_run(spark, base, "latest-test")
    assert [r.run_id for r in store.runs(spark, base).collect()] == ["01C", "01B", "01A"]
    assert store.modified(spark, base, "01C") == [] and store.replay(spark, base, "01C", e).count() == 0
    assert store.integrity(spark, base, "01C") == "not_verified" and store.integrity(spark, base, "01C", e) == "verified"
    other = e.withColumn("truth", F.when((F.col("k") == 5) & (F.col("variant") == "candidate"), "error").otherwise(F.col("truth")))
    assert [r.mismatch for r in store.replay(spark, base, "01C", other).collect()] == ["changed"] and store.integrity(spark, base, "01C", other) == "replay_failed"
    path = snapshots.current(spark, base, "01C").tables["evaluations"][0]
    other.write.mode("overwrite").parquet(path)
    assert store.modified(spark, base, "01C") == ["evaluations"] and store.integrity(spark, base, "01C", e) == "modified"
    with pytest.raises(ValueError, match="changed"):
        store.archive_run(spark, base, "01C", str(tmp_path / "archive"), ("summary",))
    receipt = store.archive_run(spark, base, "01A", str(tmp_path / "archive"), ("summary",)).collect()
    assert [(r.relation, r.n_rows, r.same) for r in receipt] == [("summary", 2, True)]
    assert store.read_relation(spark, str(tmp_path / "archive"), "01A", "summary").count() == 2
    store.delete_run(spark, base, "01A")
    assert [r.run_id for r in store.runs(spark, base).collect()] == ["01C", "01B"]
    for gone in ("01A", "never"):
        with pytest.raises(LookupError):
            store.read_relation(spark, base, gone, "summary")
    for wrong in ({"kind": "other"}, {"status": "done"}, {"relations": {"what": e}}):
        with pytest.raises(ValueError):
            store.write_run(base, "01D", **({"kind": "demo", "relations": {"summary": e}} | wrong))


def test_a_write_that_breaks_leaves_the_old_run(spark, tmp_path):
    """Whatever fails between relations, or before the list is published, readers see the run as it was."""
    base = str(tmp_path / "runs")
    one = spark.createDataFrame([("baseline", 1)], "variant string, n int")
    store.write_run(base, "01", "test", {"summary": one, "gate": one})
    two = one.withColumn("n", F.lit(2))
    broken = one.withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.write_run(base, "01", "test", {"summary": two, "gate": broken})
    assert store.read_relation(spark, base, "01", "summary").first().n == 1 and store.modified(spark, base, "01") == []
    assert len(snapshots.unlisted(spark, base)) >= 1
    store.write_run(base, "01", "test", {"summary": two})
    assert (store.read_relation(spark, base, "01", "summary").first().n, store.read_relation(spark, base, "01", "gate").first().n) == (2, 1)
    again = store.resumed(spark, base, "01")
    assert again.revision == 3 and again.tables == {} and store.integrity(spark, base, "01", one) == "not_verified"
    with pytest.raises(LookupError):
        store.resolve_run(spark, base, "latest-any")


def test_two_writers_of_one_revision(spark, tmp_path):
    base = str(tmp_path / "s")
    table = lambda n: {"t": spark.createDataFrame([(n,)], "n int")}
    assert snapshots.current(spark, base, "x").revision == 0 and snapshots.listed(spark, base).count() == 0 and snapshots.unlisted(spark, base) == []
    first = snapshots.commit(spark, base, "x", table(1), info={"who": "a"})
    mine, theirs = snapshots.current(spark, base, "x"), snapshots.current(spark, base, "x")
    snapshots.commit(spark, base, "x", table(2), after=theirs)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, base, "x", table(3), after=mine)
    now = snapshots.current(spark, base, "x")
    assert now.revision == 2 and now.info == {"who": "a"} and snapshots.read(spark, now, "t").first().n == 2 and snapshots.read(spark, first, "t").first().n == 1
    assert len(snapshots.unlisted(spark, base)) == 1
    for bad in ("", "a/b", ".x", "_x"):
        with pytest.raises(ValueError):
            snapshots.commit(spark, base, bad, {})


PLAN = {"version": 1, "evaluators": [{"id": "x", "kind": "exact", "pointers": ["/x"]}], "types": {"/x": "integer"}, "gate": {"mode": "release", "limits": gate.PROFILE}, "bootstrap": {"samples": 200}}


def made_run(spark, base, run, wrong=0):
    cases = spark.range(120).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("input"), F.concat(F.lit('{"x":'), "id", F.lit("}")).alias("expected"))
    out = lambda n: cases.select(F.col("id").alias("case_id"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_kind"), F.when(F.col("id").cast("int") < n, '{"x":-1}').otherwise(F.col("expected")).alias("raw_output"))
    made = config.run(cases, out(0), out(wrong), config.loaded(json.dumps(PLAN)))
    found = store.relations(made, cases, config.loaded(json.dumps(PLAN)).plan)
    store.write_run(base, run, "production", found)
    return made


def test_relations_of_a_run_and_its_decision(spark, tmp_path):
    base = str(tmp_path / "runs")
    good = made_run(spark, base, "01")
    sizes = {name: store.read_relation(spark, base, "01", name).count() for name in store.RELATIONS if name != "receipts"}
    assert sizes == {"cases": 120, "variants": 2, "variant_outputs": 240, "evaluator_results": 240, "outcome_results": 240, "paired_results": 2, "events": 4, "evaluations": 240, "summary": 2, "gate": 26}
    assert all(store.repeated_keys(store.read_relation(spark, base, "01", name), name).count() == 0 for name in sizes)
    shown = lambda **more: tuple(store.stored_decision(spark, base, "01", release=True, **more).select("integrity", "title", "deployment_authorized").first())
    assert shown(again=good["evaluations"]) == ("verified", "RELEASE AUTHORIZED", True)
    assert shown() == ("not_verified", "EVIDENCE NOT VERIFIED", False) and shown(again=good["evaluations"], blocking=True) == ("verified", "PINNED REGRESSION SUITE FAILED", False)


def test_pins_and_baselines(spark, tmp_path):
    base = str(tmp_path / "runs")
    good = made_run(spark, base, "01")
    decided = store.stored_decision(spark, base, "01", again=good["evaluations"], release=True)
    pin = lambda *rows: spark.createDataFrame(list(rows), "case_id string, run_id string, note string, origin_passed boolean")
    pins.save(spark, base, pin(("1", "00", "first", False), ("2", "00", None, True), ("z", "00", None, True)))
    _, read = pins.saved(spark, base)
    pins.save(spark, base, pin(("1", "01", "changed", True), ("3", "01", "new", False)))
    with pytest.raises(snapshots.Conflict):  # a second writer from the same revision
        pins.save(spark, base, pin(("4", "01", None, True)), after=read)
    rows = {r.case_id: r for r in pins.saved(spark, base)[0].collect()}
    assert set(rows) == {"1", "2", "3", "z"} and (rows["1"].note, rows["1"].run_id, rows["1"].origin_passed) == ("changed", "00", False)
    assert pins.blocking(spark, base)  # not looked at yet
    with pytest.raises(PermissionError, match="blocking"):
        pins.accept_baseline(spark, base, "01", decided)
    verdicts = good["evaluations"].where("variant = 'candidate'").select("case_id", F.col("semantic_success").alias("passes"))
    pins.refresh(spark, base, "01", verdicts)
    assert {r.case_id: r.suite_status for r in pins.saved(spark, base)[0].collect()} == {"1": "fixed", "2": "passing", "3": "fixed", "z": "missing"} and pins.blocking(spark, base)
    pins.drop(spark, base, spark.createDataFrame([("z",)], "case_id string"))
    assert not pins.blocking(spark, base) and pins.baseline(spark, base) is None
    pins.accept_baseline(spark, base, "01", decided)
    assert pins.baseline(spark, base) == "01"
    made_run(spark, base, "02", wrong=3)
    bad = spark.createDataFrame([(str(i), i > 2) for i in range(120)], "case_id string, passes boolean")
    pins.refresh(spark, base, "02", bad)  # from the stored status: 1 was fixed before
    assert {r.case_id: r.suite_status for r in pins.saved(spark, base)[0].collect()} == {"1": "reintroduced", "2": "reintroduced", "3": "fixed"}
    with pytest.raises(PermissionError, match="verified"):
        pins.accept_baseline(spark, base, "02", store.stored_decision(spark, base, "02", release=True))
    assert pins.baseline(spark, base) == "01"


def test_sinks(spark, tmp_path):
    rows = spark.range(120).select("id", (F.col("id") * 2).alias("v"))
    store.write_json_lines(rows, str(tmp_path / "lines"), "id")
    lines = records.json_lines(spark, str(tmp_path / "lines"))
    assert lines.count() == 120 and {json.loads(r.line)["id"] for r in lines.collect()} == set(range(120))
    per_file = lines.groupBy("file").agg(F.count("*").alias("n"), F.max("source_line").alias("m"), F.countDistinct("source_line").alias("d")).collect()
    assert all(r.n == r.m == r.d for r in per_file)
    store.write_chunks(review.chunks(rows, F.col("id")), str(tmp_path / "chunks"))
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "chunks")).groupBy("chunk").agg(F.count("*").alias("n")).collect()) == [20, 50, 50]
    assert "| total |" in store.summary_markdown(QUERIES["summary_rows"](spark, SF))


def test_long_files_are_numbered_in_parallel(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f"{i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = records.json_lines(spark, str(path))
        assert lines.where("line <> cast(source_line as string)").count() == 0 and lines.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_arrays_and_redaction(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1.10}, {"a": 2}]')
    assert [r.line for r in records.json_array(spark, str(tmp_path / "a.json")).orderBy("source_line").collect()] == ['{"a":1.10}', '{"a":2}']
    df = spark.createDataFrame([('{"a":{"b":1,"c":[1,2]},"d":1.0}',)], "j string").select(redact(F.col("j"), ["/a/b", "/a/c/1", "/x", "/a/c/9"]).alias("j"))
    assert df.first().j == '{"a":{"b":"[redacted]","c":[1,"[redacted]"]},"d":1.0}'
