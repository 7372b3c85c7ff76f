"""What all documents of a column look like: types and presence of every field, a schema that takes them all, keys of arrays.

A place's rows are sums and unions of types, so a task adds up its documents' places as it reads
them and gives a row for each; what leaves Python and is shuffled grows with the number of places,
not of documents.  Only the table of places comes to the driver, and a schema is put together from it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pairwright.functions.json import ITEM_KEYS, Number, parse, quoted
from pairwright.sources.scratch import written

#: Types as bits, so that a place's types are a union of numbers.
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
#: Places that a schema can have; documents whose keys are data have more.
MOST_PLACES = 10_000
#: Places that a task holds before it gives what it has added up; then it begins anew.
HELD = 100_000
#: What a task adds up: of a place, and of a member of a place's items (then ``member`` is set).
_SUMS = ("types", "n", "items", "objects", "strings", "dates", "decimals")
_KEY_SUMS = ("arrays", "whole", "unique", "several")
_SURVEY = "place string, member string, " + ", ".join(f"{c} {'int' if c == 'types' else 'long'}" for c in (*_SUMS, *_KEY_SUMS))


def _step(name: str) -> str:
    """A member's name as a step; a step of items is a star, so a star of a name is written otherwise."""
    return name.replace("~", "~0").replace("/", "~1").replace("*", "~2")


#: Likeness of texts as ``text.like_kind`` has it: a line's end after the last character counts for nothing.
_DATE = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}(\r\n|[\n\r\u0085\u2028\u2029])?").fullmatch
_DECIMAL = re.compile(r"-?[0-9]+\.[0-9]+" + "(\r\n|[\n\r\u0085\u2028\u2029])?").fullmatch
_WHOLE = re.compile("-?[0-9]+").fullmatch


class _Place:
    """Sums of a place, in the order of ``_SUMS``, its members, its items, and members of its items by name with ``_KEY_SUMS``."""

    __slots__ = ("inner", "item", "keys", "sums")

    def __init__(self) -> None:
        self.sums, self.inner, self.item, self.keys = [0] * len(_SUMS), {}, None, None

    def rows(self, at: str) -> Iterator[tuple]:
        yield at, None, *self.sums, None, None, None, None
        for name, sums in (self.keys or {}).items():
            yield at, _step(name), *[None] * len(_SUMS), *sums
        for name, place in self.inner.items():
            yield from place.rows(f"{at}/{_step(name)}")
        if self.item is not None:
            yield from self.item.rows(f"{at}/*")


def _add_keys(keys: dict[str, list[int]], items: list[dict]) -> None:
    names = dict.fromkeys(k for x in items for k in x)
    for name in names:
        values = [x[name] for x in items if name in x]
        # A number is apart from the text that reads the same.
        named = [x if type(x) is Number else quoted(x) for x in values if isinstance(x, str)]
        row = keys.get(name)
        if row is None:
            row = keys[name] = [0, 0, 0, 0]
        row[0] += 1
        row[1] += len(named) == len(items)
        row[2] += len(set(named)) == len(named)
        row[3] += len(named) > 1


def _add(value: object, place: _Place, made: list[int]) -> None:
    """Add a value and all inside it; ``made`` counts places."""
    sums, kind = place.sums, type(value)
    sums[1] += 1
    if kind is Number:
        sums[0] |= 4 if _WHOLE(value) else 8
    elif kind is str:
        sums[0] |= 16
        sums[4] += 1
        if _DATE(value):
            sums[5] += 1
        elif _DECIMAL(value):
            sums[6] += 1
    elif kind is dict:
        sums[0] |= 64
        sums[3] += 1
        inner = place.inner
        for name, x in value.items():
            at = inner.get(name)
            if at is None:
                at = inner[name] = _Place()
                made[0] += 1
            _add(x, at, made)
    elif kind is list:
        sums[0] |= 32
        sums[2] += len(value)
        if value:
            if all(type(x) is dict for x in value):
                if place.keys is None:
                    place.keys = {}
                _add_keys(place.keys, value)
            if place.item is None:
                place.item = _Place()
                made[0] += 1
            for x in value:
                _add(x, place.item, made)
    else:
        sums[0] |= 1 if value is None else 2


def survey(rows: DataFrame, column: str) -> DataFrame:
    """All that ``places``, ``members`` and ``likeness`` need of a column's documents, from one reading: a few rows for each task.

    Null and malformed texts are passed over.
    """
    kind = to_arrow_schema(StructType.fromDDL(_SURVEY))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, made = _Place(), [0]
        given = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(r for r in root.rows("") if root.sums[1]), strict=True), kind.types, strict=True)], schema=kind)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                try:
                    value = None if raw is None else [parse(raw.strip())]
                except (ValueError, RecursionError):
                    continue
                if value:
                    _add(value[0], root, made)
            if made[0] > HELD:
                yield given()
                root, made = _Place(), [0]
        if root.sums[1]:
            yield given()

    return rows.select(F.col(column).alias("doc")).mapInArrow(read, _SURVEY)


def _places(found: DataFrame) -> DataFrame:
    by = found.where("member is null").groupBy("place").agg(F.bit_or("types").alias("types"), *(F.sum(c).alias(c) for c in ("n", "items", "objects")))
    parents = by.where("objects > 0").select(F.col("place").alias("_parent"), F.col("objects").alias("of"))
    at = F.when((F.col("place") != "") & ~F.endswith("place", F.lit("/*")), F.regexp_replace("place", "/[^/]*$", ""))
    return by.withColumn("_at", at).join(parents, F.col("_at") == F.col("_parent"), "left").select("place", "types", "n", "items", "of", (F.col("n") == F.col("of")).alias("required"))


def places(rows: DataFrame, column: str, found: DataFrame | None = None) -> DataFrame:
    """Per place of the documents in a column: types (as bits), values there, items of its arrays, objects that may have it, and whether all of them do.

    Null and malformed texts have no places; the root is there as ``''``.  Only members of objects are
    required or not; of the root and of items that is null.  ``found`` is a survey of them, if there is one.
    """
    return _places(written(survey(rows, column), "survey") if found is None else found)


def likeness(found: DataFrame) -> DataFrame:
    """Per place of a survey what all its texts look like: canonical_date or decimal_exact; places of other texts are left out."""
    by = found.where("member is null").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("strings", "dates", "decimals"))).where("strings > 0")
    like = F.when(F.col("dates") == F.col("strings"), "canonical_date").when(F.col("decimals") == F.col("strings"), "decimal_exact")
    return by.select("place", like.alias("suggested")).where("suggested is not null")


def type_names(types: Column) -> Column:
    """The names of a union of types; whole numbers are numbers where both occur."""
    named = F.array_compact(F.array(*(F.when(F.getbit(types, F.lit(i)) == 1, F.lit(name)) for i, name in enumerate(TYPES))))
    return F.when(F.array_contains(named, "number"), F.array_remove(named, "integer")).otherwise(named)


def schema_of(found: DataFrame) -> dict:
    """A closed JSON Schema that every document takes which ``found`` (of ``places``) saw; a member that all objects have is required."""
    table = found.select("place", type_names(F.col("types")).alias("types"), "required").limit(MOST_PLACES + 1).collect()
    if len(table) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} places: these documents' keys are data")
    inner: dict[str, list] = {}
    for row in table:
        if row["place"]:
            parent, _, name = row["place"].rpartition("/")
            inner.setdefault(parent, []).append((name, row["place"], row["required"]))
    types = {row["place"]: row["types"] for row in table}

    def made(at: str) -> dict:
        out: dict = {"type": types[at][0] if len(types[at]) == 1 else types[at]}
        members = sorted(x for x in inner.get(at, ()) if x[0] != "*")
        if "object" in types[at]:
            plain = {name.replace("~2", "*").replace("~1", "/").replace("~0", "~"): (place, needed) for name, place, needed in members}
            out["properties"] = {name: made(place) for name, (place, _) in plain.items()}
            if needed := [name for name, (_, all_have) in plain.items() if all_have]:
                out["required"] = needed
            out["additionalProperties"] = False
        if "array" in types[at] and f"{at}/*" in types:
            out["items"] = made(f"{at}/*")
        return out

    return made("") if "" in types else {}


def discovered_schema(rows: DataFrame, column: str) -> str:
    """The schema of a column's documents as JSON text."""
    return json.dumps(schema_of(places(rows, column)), ensure_ascii=False)


def array_members(rows: DataFrame, column: str, found: DataFrame | None = None) -> DataFrame:
    """Per array of objects and member of its items: arrays that have it, those all of whose items do, as a text or number, those in which no value repeats, and those with several.

    ``found`` is a survey of the documents, if there is one.
    """
    found = survey(rows, column) if found is None else found
    return found.where("member is not null").groupBy("place", "member").agg(*(F.sum(c).alias(c) for c in _KEY_SUMS))


def array_keys(members: DataFrame, found: DataFrame) -> DataFrame:
    """For each array of objects the member that tells its items apart: place and key.

    It stands in every item of every array, repeats in none, and was put to the test by some array
    of several items; usual names come first, then others by name.  ``found`` is of ``places``,
    ``members`` of ``array_members``.
    """
    usual = F.array_position(F.array(*map(F.lit, ITEM_KEYS)), F.col("member"))
    arrays = found.where("place like '%/*' and of is null").select(F.regexp_replace("place", r"/\*$", "").alias("_place"), F.col("n").alias("_items"))
    tells = (F.col("whole") == F.col("arrays")) & (F.col("unique") == F.col("arrays")) & (F.col("several") > 0)
    # A member that some arrays lack has fewer rows than the array's items would give it.
    items = found.select(F.col("place").alias("_member"), F.col("n").alias("_with"))
    rows = members.where(tells).join(arrays, F.col("place") == F.col("_place")).join(items, F.concat("place", F.lit("/*/"), "member") == F.col("_member")).where("_with = _items")
    order = F.struct(F.when(usual > 0, usual).otherwise(len(ITEM_KEYS) + 1).alias("usual"), F.col("member").alias("member"))
    return rows.groupBy("place").agg(F.min(order).alias("k")).select("place", F.col("k.member").alias("key"))


def markdown(found: DataFrame) -> str:
    """The places (of ``places``) as a table in Markdown, for a reader; at most MOST_PLACES rows come to the driver."""
    shown = found.select("place", F.array_join(type_names(F.col("types")), ", ").alias("types"), "n", "of").orderBy("place").limit(MOST_PLACES)
    rows = [f"| `{r['place'].replace('|', '&#124;') or '/'}` | {r['types']} | {r['n']} | {'' if r['of'] is None else r['of']} |" for r in shown.collect()]
    return "\n".join(["| place | types | there | of |", "| --- | --- | --- | --- |", *rows])
