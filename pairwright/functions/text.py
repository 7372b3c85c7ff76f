"""Comparable forms of texts, dates, integers and decimals, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.json import normal_text

#: Decimals that Spark compares exactly: at most so many digits before and after the point.
DIGITS, SCALE = 18, 10
#: Formats of dates: year first, or day or month first with one of three separators.
DATE_FORMATS = {"iso": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3))} | {
    f"{order}_{name}": (rf"^(\d{{1,2}}){sign}(\d{{1,2}}){sign}(\d{{4}})$", (3, 2, 1) if order == "dmy" else (3, 1, 2))
    for order in ("dmy", "mdy") for name, sign in (("slash", "/"), ("dot", r"\."), ("dash", "-"))
}


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once, however often it is named; inside functions over arrays Spark shares nothing."""
    return F.element_at(F.transform(F.array(value), made), 1)


def normalized(text: Column, *, case_insensitive: bool = True) -> Column:
    """NFKC, which Spark lacks; white space collapsed and trimmed; lower case unless told otherwise."""
    out = F.udf(lambda s: None if s is None else normal_text(s), "string", useArrow=True)(text)
    return F.lower(out) if case_insensitive else out


def canonical_date(text: Column, formats: tuple[str, ...] = ("iso",)) -> Column:
    """The ISO text of a calendar date in the first format that fits; null for impossible dates."""
    found = []
    for name in formats:
        pattern, (y, m, d) = DATE_FORMATS[name]
        part = lambda g: F.lpad(F.regexp_extract(text, pattern, g), 4 if g == y else 2, "0")  # noqa: B023,E731
        iso = F.concat_ws("-", part(y), part(m), part(d))
        found.append(F.when(text.rlike(pattern), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")))
    return F.coalesce(*found)


def canonical_integer(text: Column) -> Column:
    """An integer's identity at any length: no spaces, no leading zeros, no minus before zero; null otherwise."""
    bare = F.trim(text)
    digits = F.regexp_replace(F.regexp_replace(bare, "^[+-]", ""), "^0+(?=[0-9])", "")
    return F.when(bare.rlike("^[+-]?[0-9]+$"), F.when((digits != "0") & bare.startswith("-"), F.concat(F.lit("-"), digits)).otherwise(digits))


def decimal_text(text: Column) -> Column:
    """An exact decimal, exponents allowed, or null for other texts and for more digits than Spark holds exactly.

    Casting rounds, so a value counts if more places give the same, and a zero only without other digits.
    """
    fits = lambda x: x.rlike(r"^-?[0-9]{1,28}(\.[0-9]{1,18})?([eE][+-]?[0-9]{1,2})?$")
    both = lambda x: F.struct(x.try_cast(f"decimal({DIGITS + SCALE},{SCALE})").alias("value"), x.try_cast("decimal(37,19)").alias("finer"))
    kept = lambda x: bound(both(x), lambda v: F.when((v["value"] == v["finer"]) & ((v["value"] != 0) | ~x.rlike(r"^-?[0-9.]*[1-9]")), v["value"]))
    return bound(text, lambda x: F.when(fits(x), kept(x)))


def like_kind(text: Column) -> Column:
    """What a text looks like: integer, decimal, date, uuid, uri or text."""
    return (
        F.when(text.rlike("^-?[0-9]+$"), "integer").when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), "decimal")
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "uuid")
        .when(text.rlike("^https?://"), "uri").when(text.isNotNull(), "text")
    )


#: Lines that hold a credential.
CREDENTIAL = r"(?i)(authorization|api[-_]?key|bearer )"


def sanitized(log: Column) -> Column:
    """A log, lines with credentials replaced."""
    lines = F.transform(F.split(log, "\n"), lambda x: F.when(x.rlike(CREDENTIAL), F.lit("[redacted]")).otherwise(x))
    return F.array_join(lines, "\n")


def truncated(text: Column, max_bytes: int, mark: str = "\n[truncated]") -> Column:
    """A text cut to so many bytes of UTF-8 at most, never inside a character, and marked; shorter ones as they are."""
    raw = text.cast("binary")
    byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    # Where the byte after the cut continues a character (binary 10...), the cut moves back to its start: three bytes at most.
    inside = lambda at: byte(at).between(128, 191)
    end = F.lit(max_bytes)
    for back in range(3):
        end = F.when((end == max_bytes - back) & inside(F.lit(max_bytes - back + 1)), F.lit(max_bytes - back - 1)).otherwise(end)
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.concat(F.substring(raw, F.lit(1), end).cast("string"), F.lit(mark)))
