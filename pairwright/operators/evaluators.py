"""Deterministic evaluators as Spark expressions on canonical JSON texts.

Each takes what pointers found in the reference and the output and gives passed, failed,
error or not_applicable.  A bad or missing reference is an error; a bad or missing output
fails.  An output that was not parsed is an error for every evaluator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import text as T
from pairwright.functions.json import json_string, json_type

PASSED, FAILED, ERROR, NOT_APPLICABLE = "passed", "failed", "error", "not_applicable"


def _verdict(passed: Column) -> Column:
    return F.when(passed, PASSED).otherwise(FAILED)


def parsed_only(parsed: Column, status: Column) -> Column:
    return F.when(F.coalesce(parsed, F.lit(False)), status).otherwise(ERROR)


def value(text: Column) -> Column:
    """The forms of a canonical JSON text that comparisons need, as ``read_values`` gives them."""
    string = json_string(text)
    kind = json_type(text)
    return F.struct(text.alias("json"), kind.alias("type"), F.coalesce(string, F.when(kind.isin("integer", "number"), text)).alias("text"), T.normalized(string, case_insensitive=False).alias("norm"))


def _compared(expected: Column, actual: Column, present: Column, same: Callable[[Column, Column], Column], *, output_first: bool = False) -> Column:
    """A reference without a form is an error, an output without one fails; ``output_first``: an absent output fails before that."""
    # Bound once: the forms would else be worked out again wherever they are named.
    both = F.struct(expected.alias("e"), actual.alias("a"))
    found = T.bound(both, lambda x: F.when(x["e"].isNull(), ERROR).when(x["a"].isNull(), FAILED).otherwise(_verdict(same(x["e"], x["a"]))))
    return F.when(~present, FAILED).otherwise(found) if output_first else found


def same_json(e: Column, a: Column) -> Column:
    """Equal canonical texts, numbers as written; a missing reference is an error even if the output misses too."""
    return exact(e["json"], a["json"])


def same_string(e: Column, a: Column, *, case_insensitive: bool = True) -> Column:
    form = (lambda x: F.lower(x)) if case_insensitive else (lambda x: x)
    return _compared(e["norm"], a["norm"], a.isNotNull(), lambda x, y: form(x) == form(y))


def same_date(e: Column, a: Column, *, formats: tuple[str, ...] = ("iso",)) -> Column:
    day = lambda v: T.canonical_date(F.when(v["type"] == "string", v["text"]), tuple(formats))
    return _compared(day(e), day(a), a.isNotNull(), lambda x, y: x == y)


def same_integer(e: Column, a: Column) -> Column:
    """Integers of any length, in numbers or strings; the output's absence is looked at first."""
    return _compared(T.canonical_integer(e["text"]), T.canonical_integer(a["text"]), a["json"].isNotNull(), lambda x, y: x == y, output_first=True)


def same_decimal(e: Column, a: Column, *, absolute: str | None = None, relative: str | None = None) -> Column:
    """Decimals within an absolute bound, or a share of the reference; equal ones always pass."""

    def near(x: Column, y: Column) -> Column:
        gap = F.abs(x - y)
        ok = gap == 0
        if absolute is not None:
            ok = ok | (gap <= F.lit(absolute).cast("decimal(18,10)"))
        if relative is not None:
            ok = ok | ((gap <= F.abs(x) * F.lit(relative).cast("decimal(9,8)")) & (x != 0))
        return ok

    return _compared(T.decimal_text(e["text"]), T.decimal_text(a["text"]), a["json"].isNotNull(), near, output_first=True)


#: Comparisons of one value with one, by the name that plans and keyed arrays use.
COMPARISONS = {"exact": same_json, "normalized_string": same_string, "canonical_date": same_date, "exact_integer": same_integer, "decimal_exact": same_decimal, "decimal": same_decimal}


def worst(*statuses: Column) -> Column:
    """Of several fields: an error if any is one, else failed if any failed."""
    first = lambda some: F.when(F.array_contains(some, ERROR), ERROR).when(F.array_contains(some, FAILED), FAILED).when(F.array_contains(some, PASSED), PASSED).otherwise(NOT_APPLICABLE)
    return T.bound(F.array(*statuses), first)


def exact(expected: Column, actual: Column) -> Column:
    """Equal canonical texts; a missing reference is an error, a missing output fails."""
    return F.when(expected.isNull(), ERROR).when(actual.isNull(), FAILED).otherwise(_verdict(expected == actual))


def normalized_string(expected: Column, actual: Column, *, case_insensitive: bool = True) -> Column:
    return same_string(value(expected), value(actual), case_insensitive=case_insensitive)


def canonical_date(expected: Column, actual: Column, formats: tuple[str, ...] = ("iso",)) -> Column:
    return same_date(value(expected), value(actual), formats=formats)


def exact_integer(expected: Column, actual: Column) -> Column:
    return same_integer(value(expected), value(actual))


def numeric_tolerance(expected: Column, actual: Column, *, absolute: str | None = None, relative: str | None = None) -> Column:
    return same_decimal(value(expected), value(actual), absolute=absolute, relative=relative)


def required_fields(*found: Column) -> Column:
    """Every pointer finds something other than null; needs no reference."""
    ok = F.lit(True)
    for x in found:
        ok = ok & x.isNotNull() & (F.coalesce(x, F.lit("null")) != "null")
    return _verdict(ok)


def keyed_array(expected: Column, actual: Column, key: str, fields: dict[str, str]) -> Column:
    """Arrays of structs matched by a key, whatever their order, then field by field.

    A struct of ``status``, ``missing`` and ``extra`` keys and the number of ``mismatched``
    items.  A key that is null or repeats is an error in the reference and a failure in the
    output.  Work on arrays of one row only; larger sides are rows and join.
    """
    keys = lambda x: F.transform(x, lambda i: i[key])
    bad = lambda x: F.exists(keys(x), lambda k: k.isNull()) | (F.size(F.array_distinct(keys(x))) < F.size(x))
    missing, extra = F.array_sort(F.array_except(keys(expected), keys(actual))), F.array_sort(F.array_except(keys(actual), keys(expected)))

    def differs(item: Column) -> Column:
        other = F.get(F.filter(actual, lambda o: o[key] == item[key]), F.lit(0))
        apart = F.lit(False)
        for name, how in fields.items():
            same = item[name].eqNullSafe(other[name]) if how == "exact" else F.coalesce(F.abs(item[name] - other[name]) <= F.lit(how).cast("decimal(18,10)"), F.lit(False))
            apart = apart | ~same
        return other.isNotNull() & apart

    mismatched = F.size(F.filter(expected, differs))
    status = (
        F.when(expected.isNull() | bad(expected), ERROR).when(actual.isNull() | bad(actual), FAILED)
        .otherwise(_verdict((F.size(missing) == 0) & (F.size(extra) == 0) & (mismatched == 0)))
    )
    usable = F.coalesce(~bad(expected) & ~bad(actual), F.lit(False))
    return F.struct(status.alias("status"), F.when(usable, missing).alias("missing"), F.when(usable, extra).alias("extra"), F.when(usable, mismatched).alias("mismatched"))


def financial_invariants(items: Column, subtotal: Column, tax: Column, total: Column, tolerance: str = "0.00") -> Column:
    """Line amounts are quantity times price, the subtotal their sum, the total subtotal and tax, within a tolerance.

    A line whose numbers are not decimals is an error and leaves the sum open, which is one too.
    """
    most = F.lit(tolerance).cast("decimal(18,10)")
    check = lambda gap: T.bound(gap, lambda g: F.when(g.isNull(), ERROR).otherwise(_verdict(F.abs(g) <= most)))

    def judged(rows: Column) -> Column:
        line = F.transform(rows, lambda i: check(i["quantity"] * i["unit_price"] - i["amount"]))
        lines = T.bound(line, lambda x: F.when(F.array_contains(x, ERROR), ERROR).when(F.array_contains(x, FAILED), FAILED).otherwise(PASSED))
        whole = F.forall(rows, lambda i: i["amount"].isNotNull())
        summed = F.aggregate(rows, F.lit(0).cast("decimal(38,4)"), lambda a, i: (a + i["amount"]).cast("decimal(38,4)"))
        return F.when(rows.isNull(), ERROR).otherwise(worst(lines, check(F.when(whole, subtotal - summed)), check(total - subtotal - tax)))

    return T.bound(items, judged)


def _matched(expected: Column, actual: Column, keys: tuple[str, ...], comparisons: tuple[tuple[str, dict], ...], made: Callable[[Column], Column]) -> Column:
    """``made`` of both sides' names and of every reference's item: whether its key has an item of the output, and the comparison's state.

    Each is worked out once; an item of the output is looked for once for each of the reference.
    """

    def keyed(items: Column) -> Column:
        def key(item: Column) -> Column:
            parts = F.array(*(F.get(item, F.lit(i))["json"] if how == "exact" else F.lower(F.get(item, F.lit(i))["norm"]) for i, how in enumerate(keys)))
            return T.bound(parts, lambda x: F.when(F.forall(x, lambda p: F.coalesce(p != "null", F.lit(False))), F.array_join(x, "\0")))

        return F.transform(items, lambda i: F.struct(key(i).alias("key"), i.alias("item")))

    def compared(item: Column, other: Column) -> Column:
        at = lambda x, n: F.get(x["item"], F.lit(len(keys) + n))
        found = worst(*(COMPARISONS[how](at(item, n), at(other, n), **options) for n, (how, options) in enumerate(comparisons))) if comparisons else F.lit(PASSED)
        return F.struct(other.isNotNull().alias("there"), F.when(other.isNotNull(), found).alias("state"))

    def both(x: Column) -> Column:
        other = lambda item: F.get(F.filter(x["a"], lambda o: o["key"] == item["key"]), F.lit(0))
        states = F.transform(x["e"], lambda item: T.bound(F.struct(item.alias("e"), other(item).alias("a")), lambda p: compared(p["e"], p["a"])))
        names = lambda side: F.transform(x[side], lambda i: i["key"])
        return F.struct(states.alias("states"), names("e").alias("e"), names("a").alias("a"))

    return T.bound(F.struct(keyed(expected).alias("e"), keyed(actual).alias("a")), lambda x: T.bound(both(x), made))


def _bad(names: Column) -> Column:
    return F.exists(names, lambda k: k.isNull()) | (F.size(F.array_distinct(names)) < F.size(names))


def _record_status(x: Column) -> Column:
    e, a, states = x["e"], x["a"], x["states"]
    failed = F.exists(states, lambda s: ~s["there"] | F.coalesce(s["state"] == FAILED, F.lit(False)))
    # With keys that are whole and differ on both sides, all found and as many on each means that none is missing or more.
    return (
        F.when(e.isNull() | _bad(e), ERROR).when(F.exists(states, lambda s: F.coalesce(s["state"] == ERROR, F.lit(False))), ERROR).when(a.isNull() | _bad(a), FAILED)
        .otherwise(_verdict((F.size(e) == F.size(a)) & ~failed))
    )


def keyed_status(expected: Column, actual: Column, keys: tuple[str, ...], comparisons: tuple[tuple[str, dict], ...]) -> Column:
    """The status of ``keyed_records`` alone."""
    return _matched(expected, actual, keys, comparisons, _record_status)


def keyed_records(expected: Column, actual: Column, keys: tuple[str, ...], comparisons: tuple[tuple[str, dict], ...]) -> Column:
    """``keyed_array`` over items as ``records`` reads them: first the keys, then the fields.

    ``keys`` names how each part of the key is taken (exact or normalized_string), and
    ``comparisons`` how each field is compared, with its options.  An item whose key is not
    whole, or a key that repeats, is an error in the reference and a failure in the output; a
    field that its comparison can't read in the reference is an error.
    """

    def made(x: Column) -> Column:
        e, a = x["e"], x["a"]
        missing, extra = F.array_sort(F.array_except(e, a)), F.array_sort(F.array_except(a, e))
        mismatched = F.size(F.filter(x["states"], lambda s: s["state"] == FAILED))
        usable = F.coalesce(~_bad(e) & ~_bad(a), F.lit(False))
        return F.struct(_record_status(x).alias("status"), F.when(usable, missing).alias("missing"), F.when(usable, extra).alias("extra"), F.when(usable, mismatched).alias("mismatched"))

    return _matched(expected, actual, keys, comparisons, made)


def financial_records(items: Column, subtotal: Column, tax: Column, total: Column, *, tolerance: str = "0.00") -> Column:
    """``financial_invariants`` over an output's JSON values; ``items`` hold quantity, unit price and amount of each line."""
    number = lambda v: T.decimal_text(v["text"])
    line = lambda i: F.struct(*(number(F.get(i, F.lit(n))).cast(kind).alias(name) for n, (name, kind) in enumerate((("quantity", "decimal(12,4)"), ("unit_price", "decimal(18,4)"), ("amount", "decimal(31,4)")))))
    money = lambda v: number(v).cast("decimal(38,4)")
    return financial_invariants(F.transform(items, line), money(subtotal), money(tax), money(total), tolerance)


def external(rows: DataFrame, evaluator_id: str, score: Callable[[pd.DataFrame], pd.Series], *, id_col: str = "case_id") -> DataFrame:
    """A user's evaluator over pandas batches, one status per row; anything else it gives, or an exception, is an error of that batch's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                status = pd.Series(score(batch), index=batch.index).where(lambda s: s.isin([PASSED, FAILED, NOT_APPLICABLE]), ERROR)
            except Exception:  # a user's code may fail in any way; its rows become errors
                status = pd.Series(ERROR, index=batch.index)
            yield pd.DataFrame({id_col: batch[id_col], "evaluator": evaluator_id, "status": status})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"{id_col} {kind}, evaluator string, status string")


def with_external(rows: DataFrame, results: DataFrame, *, id_col: str = "case_id") -> DataFrame:
    """Rows with the results of an external evaluator; one that gave none is an error."""
    return rows.join(results.select(id_col, "evaluator", "status"), id_col, "left").withColumn("status", F.coalesce("status", F.lit(ERROR)))
