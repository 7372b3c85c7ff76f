"""Profiles of JSON fields: presence, types, likeness, and suggested comparisons."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.json import leaves
from pairwright.functions.text import like_kind


def observed(rows: DataFrame, source: str, column: str) -> DataFrame:
    """Every field of every row: source, pointer (``*`` for items), type and text; the root is left out."""
    found = rows.select(F.explode(leaves(F.col(column))).alias("f"))
    text = F.when(F.col("f.type") == "string", F.get_json_object(F.concat(F.lit('{"v":'), "f.value", F.lit("}")), "$.v"))
    return found.where("f.pointer <> ''").select(F.lit(source).alias("source"), F.col("f.wide").alias("pointer"), F.col("f.type").alias("type"), text.alias("text"))


def field_profile(fields: DataFrame) -> DataFrame:
    """Per source and pointer: how often it is there, its types, and what its strings look like."""
    t = lambda name: F.count_if(F.col("type") == name).alias(f"n_{name}")
    like = lambda name: F.count_if(F.coalesce(like_kind(F.col("text")) == name, F.lit(False))).alias(f"like_{name}")
    return fields.groupBy("source", "pointer").agg(F.count("*").alias("present"), *map(t, ("string", "integer", "number", "boolean", "null", "array", "object")), *map(like, ("integer", "decimal", "date", "uuid", "uri")))


def inventory(profile: DataFrame) -> DataFrame:
    """Per pointer: its presence in each source, its type (or mixed), whether the candidate left it out, and a suggested comparison."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("present"))), F.lit(0)).alias(s)
    kinds = ("string", "integer", "number", "boolean", "array", "object")
    has = {k: F.sum(f"n_{k}") > 0 for k in kinds}
    several = sum(v.cast("int") for v in has.values()) > 1
    type_ = F.when(several, "mixed").otherwise(F.coalesce(*(F.when(v, F.lit(k)) for k, v in has.items()), F.lit("null")))
    out = profile.groupBy("pointer").agg(n("expected"), n("baseline"), n("candidate"), type_.alias("type"), F.sum("n_string").alias("strings"), F.sum("like_date").alias("dates"), F.sum("like_decimal").alias("decimals"))
    rule = (
        F.when(F.col("type") == "integer", "exact_integer").when(F.col("type") == "number", "decimal_tolerance").when(F.col("type") == "array", "keyed_array")
        .when((F.col("type") == "string") & (F.col("dates") == F.col("strings")), "canonical_date").when((F.col("type") == "string") & (F.col("decimals") == F.col("strings")), "decimal_exact")
        .when(F.col("type") == "string", "normalized_string").when(F.col("type") == "boolean", "exact")
    )
    return out.select("pointer", "expected", "baseline", "candidate", "type", ((F.col("expected") > 0) & (F.col("candidate") == 0)).alias("candidate_omits"), rule.alias("suggested"))


def mapping_candidates(fields: DataFrame) -> DataFrame:
    """Pointers through object keys alone that could map a row's parts."""
    return fields.where(~F.col("pointer").contains("*")).select("pointer").distinct()


def inspect_schema(schema: dict) -> list[tuple[str, str, bool]]:
    """Fields of a JSON Schema: pointer, type and whether required."""
    found: list[tuple[str, str, bool]] = []

    def walk(node: dict, path: str, active: tuple[str, ...]) -> None:
        ref = node.get("$ref")
        if isinstance(ref, str) and ref.startswith("#/") and ref not in active:
            inner = schema
            for step in ref[2:].split("/"):
                inner = inner.get(step.replace("~1", "/").replace("~0", "~"), {}) if isinstance(inner, dict) else {}
            walk(inner, path, (*active, ref))
        for name, part in node.get("properties", {}).items():
            at = f"{path}/{name}"
            kind = part.get("type", "any")
            found.append((at, "|".join(kind) if isinstance(kind, list) else kind, name in node.get("required", [])))
            walk(part, at, active)
        if isinstance(node.get("items"), dict):
            walk(node["items"], f"{path}/*", active)
        for i, part in enumerate(node.get("prefixItems", [])):
            found.append((f"{path}/{i}", part.get("type", "any") if isinstance(part.get("type", "any"), str) else "|".join(part["type"]), False))
            walk(part, f"{path}/{i}", active)
        # Fields that hold under a condition are fields, too, required or not only then.
        conditional = [node[k] for k in ("if", "then", "else") if isinstance(node.get(k), dict)] + [x for x in node.get("dependentSchemas", {}).values() if isinstance(x, dict)]
        for part in conditional + [x for group in ("allOf", "anyOf", "oneOf") for x in node.get(group, [])]:
            walk(part, path, active)

    walk(schema, "", ())
    return found


def schema_warnings(schema: dict) -> list[tuple[str, str]]:
    """What makes a schema hard to meet or to trust: pointer and kind of warning."""
    out: list[tuple[str, str]] = []

    def walk(node: object, path: str, depth: int) -> None:
        if not isinstance(node, dict):
            return
        kind = node.get("type")
        checks = {
            "unresolved_reference": isinstance(node.get("$ref"), str) and not node["$ref"].startswith("#"), "large_required_surface": len(node.get("required", [])) >= 10,
            "nullable_union": isinstance(kind, list) and "null" in kind, "large_enum": len(node.get("enum", [])) >= 20, "deep_nesting": depth == 5, "regex_constraint": "pattern" in node,
            "numeric_string": kind == "string" and "[0-9]" in str(node.get("pattern", "")), "boolean_string": {"true", "false"} <= {str(x).lower() for x in node.get("enum", []) if isinstance(x, str)},
        }
        out.extend((path or "/", name) for name, hit in checks.items() if hit)
        for name, part in node.get("properties", {}).items():
            walk(part, f"{path}/{name}", depth + 1)
        walk(node.get("items"), f"{path}/*", depth + 1)

    walk(schema, "", 0)
    return out


def _inspected(text: str | None) -> tuple | None:
    try:
        schema = json.loads(text or "null")
        return (inspect_schema(schema), schema_warnings(schema)) if isinstance(schema, dict) else None
    except (ValueError, RecursionError):
        return None


def inspected(text: Column) -> Column:
    """Of each JSON Schema its fields and what warns of it; null for texts that are none."""
    out = "struct<fields:array<struct<pointer:string,type:string,required:boolean>>,warnings:array<struct<pointer:string,warning:string>>>"
    return F.udf(_inspected, out, useArrow=True)(text)
