"""Finished runs: their relations as snapshots of Parquet tables, and what a reader may do with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators import gate
from pairwright.operators.review import latest_runs, replayed
from pairwright.plans.paired import Evaluation
from pairwright.sources import snapshots

#: Relations of a run, and the key of each.  Those that scoring makes are dropped when a run is resumed.
RELATIONS = {
    "cases": ("case_id",), "variants": ("variant",), "variant_outputs": ("variant", "case_id"), "evaluator_results": ("variant", "case_id", "evaluator"), "outcome_results": ("variant", "case_id"),
    "paired_results": ("effect",), "events": ("sequence",), "evaluations": ("variant", "case_id"), "summary": ("variant",), "gate": ("rule",), "receipts": ("case_id", "variant", "evaluator"),
}
DERIVED = ("evaluator_results", "outcome_results", "paired_results", "evaluations", "summary", "gate")
KINDS = ("production", "demo", "research", "test")


def relations(made: dict[str, DataFrame], cases: DataFrame, plan: Evaluation) -> dict[str, DataFrame]:
    """The relations of a run from its results (of ``plans.config.run``) and its cases.

    The remaining two of a run, its own row and its artifacts, are the snapshot's list.
    """
    e = made["evaluations"]
    parts = [c for c in ("input", "expected", "model_visible_metadata", "metadata", "source_line") if c in cases.columns]
    states = F.array(*(F.struct(F.lit(r.id).alias("evaluator"), F.lit(r.kind).alias("kind"), F.col(f"`{r.id}_state`").alias("state")) for r in plan.rules))
    spark = e.sparkSession
    definition = spark.createDataFrame([(v, repr(plan)) for v in ("baseline", "candidate")], "variant string, definition string")
    paired = None
    for effect in ("primary", "deployment"):
        row = made[effect].select(F.lit(effect).alias("effect"), "*")
        paired = row if paired is None else paired.union(row)
    events = [(n, what) for n, what in enumerate(("cases_checked", "outputs_scored", "pairs_compared", "gate_decided"), 1)]
    return {
        "cases": cases.select(F.col("id").alias("case_id"), *parts), "variants": definition,
        "variant_outputs": e.select("variant", "case_id", *(c for c in ("status", "error_kind", "raw_output", "latency_ms", "input_tokens", "output_tokens", "retries", "cost", "currency") if c in e.columns)),
        "evaluator_results": e.select("variant", "case_id", F.explode(states).alias("s")).select("variant", "case_id", "s.*"),
        "outcome_results": e.select("variant", "case_id", "truth", "fully_evaluated", "semantic_success", "deployment_success", "valid_but_wrong"), "paired_results": paired,
        "events": spark.createDataFrame(events, "sequence int, event string"), "evaluations": e.drop("expected", "raw_output"), "summary": made["summary"], "gate": made["gate"],
    }


def repeated_keys(relation: DataFrame, name: str) -> DataFrame:
    """Keys of a relation that stand there more than once; there must be none."""
    return relation.groupBy(*RELATIONS[name]).agg(F.count("*").alias("n")).where("n > 1")


def write_run(base: str, run_id: str, kind: str, relations: dict[str, DataFrame], *, status: str = "complete", after: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    """Write a run's relations and then publish them; a run written before stays readable until then, and its other relations stay."""
    if kind not in KINDS or status not in ("running", "complete"):
        raise ValueError(f"a run's kind is one of {KINDS}, and it is running or complete")
    if strange := sorted(set(relations) - set(RELATIONS)):
        raise ValueError(f"no such relations: {strange}")
    spark = next(iter(relations.values())).sparkSession
    return snapshots.commit(spark, base, run_id, relations, info={"kind": kind, "status": status}, after=after)


def resumed(spark: SparkSession, base: str, run_id: str) -> snapshots.Snapshot:
    """A run without what scoring made of it, in one step: it is running again."""
    before = _known(spark, base, run_id)
    return snapshots.commit(spark, base, run_id, {}, info={"status": "running"}, after=before, keep=tuple(set(before.tables) - set(DERIVED)))


def delete_run(spark: SparkSession, base: str, run_id: str) -> snapshots.Snapshot:
    """A run that no catalogue lists any more; its earlier revisions' files stay until they are swept."""
    return snapshots.commit(spark, base, run_id, {}, info={"status": "deleted"}, after=_known(spark, base, run_id), keep=())


def archive_run(spark: SparkSession, base: str, run_id: str, target: str, allowed: tuple[str, ...]) -> DataFrame:
    """Copy the allowed relations of a verified run to another store; returns the receipt: relation, rows, digest, whether the copy has both."""
    found = _known(spark, base, run_id)
    if strange := sorted(set(allowed) - set(found.tables)):
        raise LookupError(f"{run_id} has no {strange}")
    if wrong := snapshots.modified(spark, found):
        raise ValueError(f"only what is as it was written is archived; changed: {wrong}")
    copy = snapshots.commit(spark, target, run_id, {r: snapshots.read(spark, found, r) for r in allowed}, info=found.info | {"status": "archived"})
    rows = [(r, *found.tables[r][1:], copy.tables[r][1:] == found.tables[r][1:]) for r in sorted(allowed)]
    return spark.createDataFrame(rows, "relation string, n_rows long, digest string, same boolean")


def _known(spark: SparkSession, base: str, run_id: str) -> snapshots.Snapshot:
    found = snapshots.current(spark, base, run_id)
    if not found.revision or found.info.get("status") == "deleted":
        raise LookupError(f"no run {run_id!r}")
    return found


def runs(spark: SparkSession, base: str) -> DataFrame:
    """One row per run of the catalogue, newest first."""
    found = snapshots.listed(spark, base).where("info['kind'] IS NOT NULL AND info['status'] <> 'deleted'")
    return found.select(F.col("name").alias("run_id"), F.col("info")["kind"].alias("kind"), F.col("info")["status"].alias("status")).orderBy(F.desc("run_id"))


def resolve_run(spark: SparkSession, base: str, selector: str) -> str:
    """``latest`` (production), ``latest-KIND``, ``latest-any`` or a run's id."""
    found = runs(spark, base)
    if not selector.startswith("latest"):
        chosen = found.where(F.col("run_id") == selector).select("run_id")
    elif selector == "latest-any":
        chosen = found.where("status = 'complete'").select("run_id").limit(1)
    else:
        chosen = latest_runs(found).where(F.col("kind") == (selector.partition("-")[2] or "production")).select("run_id")
    row = chosen.first()
    if row is None:
        raise LookupError(f"no complete run for {selector!r}")
    return row["run_id"]


def read_relation(spark: SparkSession, base: str, run_id: str, name: str) -> DataFrame:
    return snapshots.read(spark, _known(spark, base, run_id), name)


def modified(spark: SparkSession, base: str, run_id: str) -> list[str]:
    """Relations that no longer are what was written."""
    return snapshots.modified(spark, _known(spark, base, run_id))


def replay(spark: SparkSession, base: str, run_id: str, again: DataFrame) -> DataFrame:
    """Evaluations of a stored run that a recomputation gives otherwise; none verify it."""
    stored = read_relation(spark, base, run_id, "evaluations").withColumn("key", F.concat_ws("\0", "variant", "case_id"))
    columns = [c for c in ("status", "parse_valid", "schema_valid", "components", "truth", "fully_evaluated") if c in stored.columns]
    return replayed(stored, again.withColumn("key", F.concat_ws("\0", "variant", "case_id")), "key", columns)


def integrity(spark: SparkSession, base: str, run_id: str, again: DataFrame | None = None) -> str:
    """Whether a stored run is what was written and what its inputs give: not_verified, modified, replay_failed or verified.

    Without a recomputation, or while the run isn't complete, nothing is verified.
    """
    found = _known(spark, base, run_id)
    if found.info.get("status") not in ("complete", "archived"):
        return "not_verified"
    if snapshots.modified(spark, found):
        return "modified"
    if again is None:
        return "not_verified"
    return "replay_failed" if replay(spark, base, run_id, again).limit(1).count() else "verified"


def stored_decision(spark: SparkSession, base: str, run_id: str, *, again: DataFrame | None = None, blocking: bool = False, release: bool = False) -> DataFrame:
    """The decision of a stored run's gate with its integrity and title; only a verified run without a blocking saved case authorises a deployment."""
    state = integrity(spark, base, run_id, again)
    decided = gate.decision(read_relation(spark, base, run_id, "gate"), release=release)
    titled = gate.headline(decided, F.lit(state), F.lit(blocking), release=release).withColumn("integrity", F.lit(state))
    return titled.withColumn("deployment_authorized", F.col("deployment_authorized") & F.lit(state == "verified" and not blocking))


def write_json_lines(rows: DataFrame, path: str, order: str) -> None:
    """Rows as JSON lines in order; files follow each other in it."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def write_chunks(cases: DataFrame, path: str) -> None:
    """A report's cases as JSON, a folder for each chunk."""
    cases.repartition("chunk").sortWithinPartitions("chunk", "place").write.partitionBy("chunk").json(path)


def summary_markdown(rows: DataFrame) -> str:
    """A small table of metrics (metric, baseline, candidate, change) as Markdown."""
    lines = [f"| {r['metric']} | {r['baseline']} | {r['candidate']} | {r['change']:+} |" for r in rows.orderBy("metric").collect()]
    return "\n".join(["| metric | baseline | candidate | change |", "| --- | --- | --- | --- |", *lines])
