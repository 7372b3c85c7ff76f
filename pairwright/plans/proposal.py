"""A first configuration from references alone: what they hold at every place, and which member tells an array's items apart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators import discovery
from pairwright.plans.paired import Evaluation, Rule, reference_issues
from pairwright.sources.scratch import written

#: Comparisons for what values of a place are, where all of them are that.
_BY_TYPE = {"integer": "exact_integer", "number": "decimal", "boolean": "exact"}
_BY_LIKENESS = {"canonical_date": "canonical_date", "decimal_exact": "decimal"}


def _pointer(place: str) -> str:
    return place.replace("~2", "*")


def _kind(types: list[str], suggested: str | None) -> str:
    """A comparison for one scalar type; a union of types, which no other takes, is compared as it stands."""
    if len(types) > 1 or types[0] not in ("string", *_BY_TYPE):
        return "exact"
    return _BY_TYPE.get(types[0]) or _BY_LIKENESS.get(suggested or "", "normalized_string")


def proposed(cases: DataFrame, column: str = "expected") -> str:
    """A configuration as JSON text, to be read over before it is used: evaluators, and a schema inferred from the references.

    A place that every reference has and that isn't inside another proposed one gets an evaluator;
    an array of objects is compared by the member that tells items apart, if one does.  A comparison
    that some reference would not pass against itself gives way to one of texts as they stand.
    """
    read = written(discovery.survey(cases, column), "survey")  # a few rows for each task
    found = discovery.places(cases, column, read)
    schema = discovery.schema_of(found)
    likeness = {r["place"]: r["suggested"] for r in discovery.likeness(read).collect()}
    table = {r["place"]: r for r in found.select("place", discovery.type_names(F.col("types")).alias("types"), "required").collect()}
    keys = {r["place"]: r["key"] for r in discovery.array_keys(discovery.array_members(cases, column, read), found).collect()}
    always = lambda place: place == "" or (bool(table[place]["required"]) and always(place.rpartition("/")[0]))
    kind = lambda place: _kind(table[place]["types"], likeness.get(place))
    rules = []
    for place in sorted(p for p in table if p and "/*" not in p and always(p)):
        types, name = table[place]["types"], _pointer(place)[1:].replace("/", ".")
        if types == ["object"]:
            continue  # its members have their own
        if types == ["array"] and place in keys:
            items = [p for p in table if p.startswith(f"{place}/*/") and p.count("/") == place.count("/") + 2 and table[p]["required"] and not {"array", "object", "null"} & set(table[p]["types"])]
            at = {p: p.removeprefix(f"{place}/*") for p in items}
            key = f"/{keys[place]}"
            fields = {_pointer(at[p]): [kind(p)] for p in sorted(items) if at[p] != key}
            rules.append({"id": name, "kind": "keyed_array", "pointers": [_pointer(place)], "options": {"keys": {_pointer(key): "exact"}, "fields": fields}})
        else:
            rules.append({"id": name, "kind": kind(place), "pointers": [_pointer(place)]})
    if not rules:
        raise ValueError("no place that all references have: nothing can be proposed")
    made = lambda r: Rule(r["id"], r["kind"], tuple(r["pointers"]), None, {k: {p: (how[0], {}) if isinstance(how, list) else how for p, how in v.items()} for k, v in r.get("options", {}).items()})
    faulty = {r["evaluator"] for r in reference_issues(cases.withColumn("expected", F.col(column)), Evaluation(tuple(map(made, rules)))).select("evaluator").distinct().collect()}
    for r in rules:
        if r["id"] in faulty:
            r["kind"] = "exact"
            r.pop("options", None)
    return json.dumps({"version": 1, "evaluators": rules, "schema": schema, "schema_provenance": "inferred"}, ensure_ascii=False, indent=2)
