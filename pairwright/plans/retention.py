"""What is kept of outputs when their texts may not be: the values that a plan compares, and a receipt of the rest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.json import MISSING, canonical, parse, resolve
from pairwright.functions.schema import _errors
from pairwright.plans.paired import Evaluation, _arrays, _pointers, evaluate_all, judged

RECEIPT = "struct<valid:boolean,schema_valid:boolean,digest:string,bytes:long>"
#: Stands for a text that is no JSON: it isn't kept, but stays none.
_MALFORMED = "{"
#: What an inference leaves in an output's metadata that identifies it or repeats what was sent.
DROPPED = ("/id", "/request_id", "/messages", "/prompt", "/provider_body", "/headers", "/details")


def _placed(out: dict, pointer: str, value: object) -> None:
    """Put a value at a pointer, objects made on the way; an array on the way is an object whose names are places, which pointers read alike."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    for step in steps[:-1]:
        out = out.setdefault(step, {})
    out[steps[-1]] = value


def retained(outputs: DataFrame, plan: Evaluation) -> DataFrame:
    """Outputs whose ``raw_output`` holds what the plan reads alone, with a receipt: whether it parsed, kept to the schema, and a digest of all of it.

    Metadata, where there is any, loses DROPPED.  A plan that reads the whole document (the pointer
    ``''``) keeps it.  Null texts stay null and have no receipt.
    """
    wanted = sorted({*_pointers(plan), *(p for p, _ in _arrays(plan, False))}, key=len)
    inside = {}
    for pointer, names in _arrays(plan, False):
        inside.setdefault(pointer, set()).update(names)
    rules = None if plan.schema is None else parse(plan.schema)

    def cut(raw: str | None) -> tuple | None:
        if raw is None:
            return None
        size, whole = len(raw.encode()), hashlib.sha256(raw.encode()).hexdigest()
        try:
            value = parse(raw.strip())
            fits = None if rules is None else not _errors(value, rules, rules, "", 0)
        except (ValueError, RecursionError, ArithmeticError):
            return _MALFORMED, (False, None, whole, size)
        out: dict = {}
        for pointer in wanted:
            found = resolve(value, pointer)
            if not pointer:
                return canonical(value), (True, fits, whole, size)
            if found is MISSING or any(pointer.startswith(f"{p}/") and resolve(out, p) is not MISSING for p in wanted if p != pointer and p):
                continue
            if pointer in inside and isinstance(found, list) and all(isinstance(x, dict) for x in found):
                rows = []
                for item in found:
                    row: dict = {}
                    for name in sorted(inside[pointer]):
                        if (x := resolve(item, name)) is not MISSING:
                            _placed(row, name, x)
                    rows.append(row)
                found = rows
            _placed(out, pointer, found)
        return canonical(out), (True, fits, whole, size)

    kept = F.udf(cut, f"struct<raw_output:string,receipt:{RECEIPT}>", useArrow=True)(F.col("raw_output"))
    rows = outputs.withColumn("_kept", kept).withColumns({"raw_output": F.col("_kept.raw_output"), "receipt": F.col("_kept.receipt")}).drop("_kept")
    return rows.withColumn("metadata", without(F.col("metadata"), DROPPED)) if "metadata" in outputs.columns else rows


def without(text, pointers: tuple[str, ...]):
    """Canonical JSON text without the members at the pointers; null for malformed texts, of which nothing is kept."""

    def dropped(raw: str | None) -> str | None:
        try:
            value = parse(raw or "")
        except (ValueError, RecursionError):
            return None
        for pointer in pointers:
            parent, _, last = pointer.rpartition("/")
            inner = resolve(value, parent)
            if isinstance(inner, dict):
                inner.pop(last.replace("~1", "/").replace("~0", "~"), None)
        return canonical(value)

    return F.udf(dropped, "string", useArrow=True)(text)


def evaluated(cases: DataFrame, outputs: dict[str, DataFrame], plan: Evaluation) -> DataFrame:
    """Evaluations from retained outputs: those that the whole texts gave, but for the output itself, of which the receipt's digest is told."""
    plain = Evaluation(plan.evaluators, plan.types, plan.outcome, plan.primary)
    e = evaluate_all(cases, outputs, plain)
    if plan.schema is not None:
        e = e.withColumn("schema_valid", F.col("schema_valid") & F.coalesce("receipt.schema_valid", F.lit(False)))
        e = judged(e, plan)
    return e.withColumn("output", F.col("receipt.digest"))


def policy(name: str) -> str:
    """What a policy keeps of texts: ``full``, ``sanitized`` (what is compared) or ``off`` (receipts alone)."""
    if name not in ("full", "sanitized", "off"):
        raise ValueError(f"a policy is full, sanitized or off: {name!r}")
    return name


def under(outputs: DataFrame, plan: Evaluation, how: str) -> DataFrame:
    """Outputs as a policy keeps them; where nothing is kept of texts, a replay can check receipts but not score."""
    if policy(how) == "full":
        return outputs
    kept = retained(outputs, plan)
    return kept if how == "sanitized" else kept.withColumn("raw_output", F.lit(None).cast("string"))


def manifest(how: str, plan: Evaluation) -> str:
    """What a report says of what was kept, as JSON text."""
    return json.dumps({"policy": policy(how), "kept": sorted(_pointers(plan)) if how == "sanitized" else how, "dropped": list(DROPPED) if how != "full" else []})
