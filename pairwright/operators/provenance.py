"""Where a run's settings came from, and whether its manifest tells the same as its configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.json import leaves


def settings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Every setting of each row's configuration: key, pointer and value; objects and arrays that are empty count as values."""
    found = rows.select(key, F.explode(leaves(F.col(column))).alias("s"))
    ends = found.select(key, F.col("s.pointer").alias("pointer"), F.col("s.type").alias("type"), F.col("s.value").alias("value"))
    parents = ends.where("pointer <> ''").select(F.col(key).alias("_key"), F.regexp_replace("pointer", "/[^/]*$", "").alias("_parent")).distinct()
    whole = ends.join(parents, F.col(key).eqNullSafe(F.col("_key")) & (F.col("pointer") == F.col("_parent")), "left_anti")
    return whole.select(key, "pointer", F.coalesce("value", F.when(F.col("type") == "object", "{}").otherwise("[]")).alias("value"))


def overridden(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Settings with the value that holds, the one it replaced, and its source: ``configuration``, ``override`` (it changed a value) or ``added``.

    Both are of ``settings``; a setting without an override stays.
    """
    b, o = base.alias("b"), overrides.alias("o")
    both = b.join(o, F.col(f"b.{key}").eqNullSafe(F.col(f"o.{key}")) & (F.col("b.pointer") == F.col("o.pointer")), "full_outer")
    source = F.when(F.col("o.pointer").isNull() | F.col("o.value").eqNullSafe(F.col("b.value")), "configuration").when(F.col("b.pointer").isNull(), "added").otherwise("override")
    return both.select(F.coalesce(f"b.{key}", f"o.{key}").alias(key), F.coalesce("b.pointer", "o.pointer").alias("pointer"), F.coalesce("o.value", "b.value").alias("value"), F.col("b.value").alias("replaced"), source.alias("source"))


def disagreements(manifest: DataFrame, configuration: DataFrame, key: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Settings in which a run's manifest and its configuration differ, or that one of them lacks; of ``fields`` (pointers, and what lies in them) alone if given."""
    m, c = manifest.alias("m"), configuration.alias("c")
    both = m.join(c, F.col(f"m.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("m.pointer") == F.col("c.pointer")), "full_outer")
    rows = both.select(F.coalesce(f"m.{key}", f"c.{key}").alias(key), F.coalesce("m.pointer", "c.pointer").alias("pointer"), F.col("m.value").alias("manifest"), F.col("c.value").alias("configuration"))
    rows = rows.where(~F.col("manifest").eqNullSafe(F.col("configuration")))
    return rows if fields is None else rows.where(_within(F.col("pointer"), fields))


def _within(pointer: Column, fields: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for field in fields:
        found = found | (pointer == field) | F.startswith(pointer, F.lit(f"{field}/"))
    return found
