"""A whole run from one configuration: what is compared, what a unit of evidence is, and the gate's limits."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.json import Number, canonical, parse
from pairwright.operators import evidence, gate, summary
from pairwright.operators.pairing import paired
from pairwright.plans.paired import Evaluation, Rule, dealt, evaluate_all, reference_issues
from pairwright.sources.scratch import written

#: Limits that are shares, and so lie between 0 and 1.
_SHARES = ("_rate", "_validity", "_coverage")
#: What a gate is for: to tell, to stop regressions, to authorise a deployment.
MODES = ("advisory", "regression", "release")


@dataclass(frozen=True)
class Config:
    """A checked configuration; ``plan`` says what is compared.

    A regression or release gate limits all of ``gate.SAFEGUARDS`` and at least one of
    ``gate.RELATIVE``; a release gate keeps to ``gate.PROFILE``, and its outputs' schema is the
    caller's own, not one ``inferred`` from references.
    """

    plan: Evaluation
    limits: dict[str, float] = field(default_factory=dict)
    mode: str = "advisory"
    unit: str | None = None  # a pointer into the case; else the values at all of include
    include: tuple[str, ...] = evidence.INCLUDE
    samples: int = 10_000
    confidence: float = 0.95
    seed: int = 0
    inferred: bool = False

    def __post_init__(self) -> None:
        names = {name for name, _, _ in gate.RULES}
        if bad := sorted(set(self.limits) - names):
            raise ValueError(f"no such rules: {bad}")
        if bad := sorted(k for k, v in self.limits.items() if not _is_number(v) or v < 0 or (k.endswith(_SHARES) and v > 1)):
            raise ValueError(f"limits out of range: {bad}")
        if self.mode not in MODES:
            raise ValueError(f"a gate's mode is one of {MODES}")
        if self.mode != "advisory":
            if bad := [k for k in gate.SAFEGUARDS if k not in self.limits]:
                raise ValueError(f"a {self.mode} gate needs limits: {bad}")
            if not set(gate.RELATIVE) & set(self.limits):
                raise ValueError(f"a {self.mode} gate needs one of: {gate.RELATIVE}")
        if self.mode == "release":
            if bad := gate.lax(self.limits):
                raise ValueError(f"a release gate keeps to the safe release profile; it does not at: {bad}")
            if self.inferred or (self.plan.schema is None and not self.plan.types):
                raise ValueError("a release gate needs the caller's own schema of outputs")
        if any(isinstance(x, bool) or not isinstance(x, int) for x in (self.samples, self.seed)) or not _is_number(self.confidence):
            raise ValueError("samples and seed are whole numbers, confidence is a number")
        if not 100 <= self.samples <= 1_000_000 or not 0.5 <= self.confidence < 1 or self.seed < 0:
            raise ValueError("100 to 1,000,000 samples, a confidence from 0.5 up to 1, and no negative seed")
        if self.unit is not None and self.include != evidence.INCLUDE:
            raise ValueError("a unit is named by a pointer or by an include list, not by both")


def _is_number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)


def _plain(value: object) -> object:
    """A parsed value with usual numbers; options keep decimals as texts."""
    if isinstance(value, Number):
        return int(value) if value.lstrip("-").isdigit() else float(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _known(part: object, name: str, keys: dict[str, type]) -> dict:
    """An object whose members all have their kind; a number is no text."""
    if not isinstance(part, dict) or (strange := set(part) - set(keys)):
        raise ValueError(f"{name}: unknown {sorted(strange) if isinstance(part, dict) else 'value'}")
    for k, v in part.items():
        if not isinstance(v, keys[k]) or (keys[k] is str and isinstance(v, Number)):
            raise ValueError(f"{name}: {k} is no {NAMES[keys[k]]}")
    return part


NAMES = {str: "text", Number: "number", dict: "object", list: "array", bool: "truth value", dict | bool: "schema"}


def _texts(part: dict, key: str, name: str) -> tuple[str, ...]:
    values = part.get(key, [])
    if any(not isinstance(v, str) or isinstance(v, Number) for v in values):
        raise ValueError(f"{name}: {key} holds texts")
    return tuple(values)


def _options(rule: dict) -> dict:
    """An evaluator's options in the shapes that its kind takes; what they may say is the plan's to check."""
    options = {}
    for key, value in rule.get("options", {}).items():
        if key in ("keys", "fields"):
            value = _known(value, f"options of {rule['id']}", dict.fromkeys(value, str if key == "keys" else list) if isinstance(value, dict) else {})
        if key == "fields":
            if any(not 1 <= len(how) <= 2 or not isinstance(how[0], str) or not isinstance(how[-1] if len(how) > 1 else {}, dict) for how in value.values()):
                raise ValueError(f"options of {rule['id']}: a field is compared by [kind] or [kind, options]")
            value = {p: (how[0], how[1] if len(how) > 1 else {}) for p, how in value.items()}
        elif key in ("formats", "line"):
            value = _texts(_known({key: value}, f"options of {rule['id']}", {key: list}), key, f"options of {rule['id']}")
        elif key == "case_insensitive":
            _known({key: value}, f"options of {rule['id']}", {key: bool})
        elif key in ("absolute", "relative", "tolerance") and (not isinstance(value, str) or not re.fullmatch(r"[0-9]+(\.[0-9]+)?", value)):
            raise ValueError(f"options of {rule['id']}: {key} is a decimal that is not negative")
        options[key] = value
    return options


def loaded(text: str) -> Config:
    """A configuration from strict JSON; unknown names, kinds and limits, and values of other types, are refused.

    ``{"version": 1, "evaluators": [{"id", "kind", "pointers", "expected"?, "options"?}], "primary"?, "outcome"?,
    "types"?, "schema"?, "schema_provenance"? (caller or inferred), "evidence_unit"?: {"pointer" or "include"}, "gate"?: {"mode"?, "limits"},
    "bootstrap"?: {"samples"?, "confidence"?, "seed"?}}``
    """
    raw = _known(parse(text), "configuration", {
        "version": Number, "evaluators": list, "primary": list, "outcome": str, "types": dict, "schema": dict | bool, "schema_provenance": str, "evidence_unit": dict, "gate": dict, "bootstrap": dict,
    })
    if raw.get("version") != "1":
        raise ValueError("a configuration has version 1")
    rules = []
    for r in raw.get("evaluators", []):
        _known(r, "evaluator", {"id": str, "kind": str, "pointers": list, "expected": list, "options": dict})
        if lost := [k for k in ("id", "kind") if k not in r]:
            raise ValueError(f"an evaluator without {lost}")
        rules.append(Rule(r["id"], r["kind"], _texts(r, "pointers", r["id"]), _texts(r, "expected", r["id"]) if "expected" in r else None, _options(r)))
    parts = {"evidence_unit": {"pointer": str, "include": list}, "gate": {"mode": str, "limits": dict}, "bootstrap": {"samples": Number, "confidence": Number, "seed": Number}}
    unit, g, b = (_known(raw.get(n, {}), n, keys) for n, keys in parts.items())
    types = _known(raw.get("types", {}), "types", dict.fromkeys(raw.get("types", {}), str))
    limits = _known(g.get("limits", {}), "limits", dict.fromkeys(g.get("limits", {}), Number))
    provenance = raw.get("schema_provenance", "caller")
    if provenance not in ("caller", "inferred"):
        raise ValueError("a schema comes from the caller or is inferred")
    plan = Evaluation(tuple(rules), tuple(types.items()), raw.get("outcome", "all_of"), _texts(raw, "primary", "configuration") if "primary" in raw else None, canonical(raw["schema"]) if "schema" in raw else None)
    include = _texts(unit, "include", "evidence_unit") if "include" in unit else evidence.INCLUDE
    return Config(plan, _plain(limits), g.get("mode", "advisory"), unit.get("pointer"), include, **_plain(b), inferred=provenance == "inferred")


#: What was observed of a case, by variant.
OBSERVED = ("status", "error_kind", "parse_valid", "schema_valid", "components", "truth", "output", "latency_ms", "input_tokens", "output_tokens", "retries", "cost", "currency")


def _observation(pairs: DataFrame) -> Column:
    there = [c for c in OBSERVED if c in pairs.schema["baseline"].dataType.names]
    return evidence.digest(*(F.to_json(F.struct(*(F.col(f"{s}.{c}") for c in there))) for s in ("baseline", "candidate")))


#: Columns of outputs that summaries read; those that a variant's table lacks are unknown.
_MEASURES = {"error_kind": "string", "latency_ms": "long", "input_tokens": "long", "output_tokens": "long", "retries": "int", "cost": "decimal(28,10)", "currency": "string"}


def id_faults(cases: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """Ids that a run can't take: id, table and fault (null, repeated or, in outputs, unknown).

    One aggregate over the ids of all tables; nothing else of them is read or moved.
    """
    tables = {"cases": cases.select(F.col("id").alias("id"))} | {name: df.select(F.col("case_id").alias("id")) for name, df in outputs.items()}
    ids = None
    for name, df in tables.items():
        named = df.select("id", F.lit(name).alias("table"))
        ids = named if ids is None else ids.union(named)
    n = {name: F.count_if(F.col("table") == name) for name in tables}
    by = ids.groupBy("id").agg(*(v.alias(f"n_{name}") for name, v in n.items()))
    fault = lambda name, what, when: F.when((F.col(f"n_{name}") > 0) & when, F.struct(F.lit(name).alias("table"), F.lit(what).alias("fault")))
    found = [fault(name, "null", F.col("id").isNull()) for name in tables]
    found += [fault(name, "repeated", F.col("id").isNotNull() & (F.col(f"n_{name}") > 1)) for name in tables]
    found += [fault(name, "unknown", F.col("id").isNotNull() & (F.col("n_cases") == 0)) for name in outputs]
    return by.select("id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("id", "f.*")


def evaluations(cases: DataFrame, baseline: DataFrame, candidate: DataFrame, config: Config, external: DataFrame | None = None) -> DataFrame:
    """Both variants' evaluations of cases that can be judged, with the units of evidence; not run until it is asked for."""
    found, _ = evidence.with_units(dealt(cases), config.unit, config.include)
    whole = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in _MEASURES.items() if c not in df.columns})
    return evaluate_all(found, {"baseline": whole(baseline), "candidate": whole(candidate)}, config.plan, external)


def run(cases: DataFrame, baseline: DataFrame, candidate: DataFrame, config: Config, external: DataFrame | None = None) -> dict[str, DataFrame]:
    """The relations of a run: evaluations, summaries, paired metrics of both effects, the gate's rules and its decision.

    Null, repeated and unknown ids stop the run, and so do cases whose reference an evaluator would
    not pass, or that have no unit of evidence; all that before outputs are parsed.  The error tells
    how many there are and the first 20.  Evaluations are made once and written; all else reads them.
    """
    strange = id_faults(cases, {"baseline": baseline, "candidate": candidate})
    if (n := strange.count()) > 0:
        raise ValueError(f"{n} ids that can't be taken: {[tuple(r) for r in strange.orderBy('id', 'table', 'fault').limit(20).collect()]}")
    _, lost = evidence.with_units(dealt(cases), config.unit, config.include)
    bad = [(r.id, r.what) for r in reference_issues(cases, config.plan).select("id", F.concat_ws(": ", "evaluator", "state").alias("what")).union(lost.select("id", "pointer")).orderBy("id", "what").limit(20).collect()]
    if bad:
        raise ValueError(f"cases that can't be judged: {bad}")
    e = evaluations(cases, baseline, candidate, config, external)
    e = written(e.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in e.dtypes if kind == "void"}), "evaluations")
    p = paired(e)
    inputs = gate.inputs(p, stimulus=F.col("baseline.unit"), reference=F.col("baseline.expected"), observation=_observation(p), samples=config.samples, confidence=config.confidence, seed=config.seed)
    rules = gate.rules(inputs, config.limits)
    return {
        "evaluations": e, "summary": summary.variant_summary(e), "operational": summary.operational_summary(e), "primary": summary.paired_metrics(p, "semantic_success"),
        "deployment": summary.paired_metrics(p, "deployment_success"), "inputs": inputs, "gate": rules, "decision": gate.decision(rules, release=config.mode == "release"),
    }
