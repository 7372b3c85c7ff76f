"""Strict JSON that keeps number texts: parsing, canonical text, pointers.

Spark's own parsers renormalise numbers, keep the last of repeated keys and ignore what
follows a value, so strict reading is one Arrow UDF that also resolves every pointer asked
for; all comparisons after it are Spark expressions on canonical text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from json.encoder import encode_basestring as quoted

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


class Number(str):
    """A number's text as written."""


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        seen: set[str] = set()
        raise ValueError(f"duplicate key {next(k for k, _ in pairs if k in seen or seen.add(k))!r}")
    return out


def _constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON number")


#: Made once: a decoder for each text costs as much as a small text's reading.
_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_constant, object_pairs_hook=_object)


def parse(text: str) -> object:
    """The value of a whole JSON text; raises on repeated keys, other text and non-finite numbers."""
    if text.startswith("\ufeff"):
        raise ValueError("a byte order mark is no JSON")
    return _DECODER.decode(text)


def canonical(value: object) -> str:
    """JSON text with sorted keys and numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join([f"{quoted(k)}:{canonical(value[k])}" for k in sorted(value)]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def each(f: Callable, kind: str, *columns: Column, once: bool = False) -> Column:
    """``f`` of each row's values as an Arrow UDF of a type; columns become Python values and back as a whole, not value by value.

    ``once``: a filter on what it gives doesn't run it again, nor before rows have been dealt out.
    """
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def one(values: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in values.to_pylist()], arrow)

    def many(*values: pa.Array) -> pa.Array:
        return pa.array([f(*x) for x in zip(*(v.to_pylist() for v in values), strict=True)], arrow)

    made = F.arrow_udf(one if len(columns) == 1 else many, kind)
    return (made.asNondeterministic() if once else made)(*columns)


#: What a pointer that leads nowhere finds; one object in every process.
MISSING = ...


@lru_cache(4096)
def _steps(pointer: str) -> tuple[tuple[str, int | None], ...]:
    """A pointer's steps: the member's name, and the place in an array if it can be one."""
    names = [x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]]
    return tuple((x, int(x) if re.fullmatch("0|[1-9][0-9]{0,17}", x) else None) for x in names)


def resolve(value: object, pointer: str) -> object:
    """What an RFC 6901 pointer finds, or MISSING."""
    for step, place in _steps(pointer):
        if isinstance(value, dict) and step in value:
            value = value[step]
        elif place is not None and isinstance(value, list) and place < len(value):
            value = value[place]
        else:
            return MISSING
    return value


_NAMES = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
_WHOLE = re.compile("-?[0-9]+").fullmatch


def kind(value: object) -> str:
    if isinstance(value, Number):
        return "integer" if _WHOLE(value) else "number"
    return _NAMES[type(value)]


READ = "struct<error:string,canonical:string,found:array<string>>"


def read_json(text: Column, pointers: list[str], *, once: bool = False) -> Column:
    """A struct: why the text is no strict JSON (or null), its canonical text, and what each pointer finds.

    A found value is canonical JSON text, ``null`` for a JSON null; absent values are null.  ``once`` as for ``each``.
    """

    def read(raw: str | None) -> tuple | None:
        if raw is None:
            return None
        try:
            value = parse(raw.strip())
        except (ValueError, RecursionError) as e:
            return str(e) or "malformed", None, None
        found = [resolve(value, p) for p in pointers]
        return None, canonical(value), [None if x is MISSING else canonical(x) for x in found]

    return each(read, READ, text, once=once)


def normal_text(text: str) -> str:
    """A text in NFKC, white space trimmed and runs of it one space; letter case as it was."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


#: A found value: its canonical JSON text, its type's name, a string's or number's own text, and a string's normal text.
VALUE = "struct<json:string,type:string,text:string,norm:string>"


def _typed(value: object) -> tuple | None:
    if value is MISSING:
        return None
    if isinstance(value, Number):
        text = str(value)
        return text, kind(value), text, None
    if isinstance(value, str):
        return quoted(value), "string", value, normal_text(value)
    return canonical(value), kind(value), None, None


def _items(value: object, pointers: list[str]) -> list | None:
    """Of an array of objects, each item's values at the pointers; None for anything else."""
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        return None
    if all(len(_steps(p)) == 1 for p in pointers):
        names = [_steps(p)[0][0] for p in pointers]
        return [[_typed(x.get(name, MISSING)) for name in names] for x in value]
    return [[_typed(resolve(x, p)) for p in pointers] for x in value]


def read_values(text: Column, pointers: list[str], items: list[tuple[str, list[str]]] | tuple = (), *, whole: bool = True) -> Column:
    """As ``read_json``, each found value in the forms that comparisons need, so that nothing is parsed again; no canonical text unless ``whole``.

    ``items`` names arrays by pointer, with pointers into their items: ``items`` of the result has the
    items' values as ``records`` gives them, for each array named.
    """

    def read(raw: str | None) -> tuple | None:
        if raw is None:
            return None
        try:
            value = parse(raw.strip())
        except (ValueError, RecursionError) as e:
            return str(e) or "malformed", None, None, None
        return None, canonical(value) if whole else None, [_typed(resolve(value, p)) for p in pointers], [_items(resolve(value, p), inside) for p, inside in items]

    return each(read, f"struct<error:string,canonical:string,found:array<{VALUE}>,items:array<array<array<{VALUE}>>>>", text)


def records(text: Column, pointers: list[str]) -> Column:
    """Of a JSON array of objects, each item's values at the pointers; null for anything else."""

    def read(raw: str | None) -> list | None:
        return None if raw is None else _items(parse(raw), pointers)

    return each(read, f"array<array<{VALUE}>>", text)


def leaves(text: Column) -> Column:
    """Every place of a document: pointer, aggregation pointer (``*`` for items), type, and canonical text of scalars."""

    def walk(value: object, path: str, wide: str, out: list) -> None:
        scalar = not isinstance(value, dict | list)
        out.append((path, wide, kind(value), canonical(value) if scalar else None))
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for step, inner in items:
            name = str(step).replace("~", "~0").replace("/", "~1")
            walk(inner, f"{path}/{name}", f"{wide}/{'*' if isinstance(value, list) else name}", out)

    def flat(raw: str | None) -> list:
        out: list = []
        if raw is not None:
            try:
                walk(parse(raw), "", "", out)
            except (ValueError, RecursionError):
                return []
        return out

    return each(flat, "array<struct<pointer:string,wide:string,type:string,value:string>>", text)


def scalars(text: Column) -> Column:
    """Every scalar of a document but nulls, as canonical texts, whatever its depth."""
    return F.transform(F.filter(leaves(text), lambda x: x["value"] != "null"), lambda x: x["value"])


def json_string(text: Column) -> Column:
    """The string that a JSON string text stands for; null for other types."""
    return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))


def json_type(text: Column) -> Column:
    """The type's name of a canonical JSON text."""
    first = F.substring(text, 1, 1)
    return (
        F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(text == "null", "null")
        .when(text.isin("true", "false"), "boolean").when(text.rlike("^-?[0-9]+$"), "integer").when(text.isNotNull(), "number")
    )


def escape_pointer(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointers_overlap(left: str, right: str) -> bool:
    """One pointer is the other or leads to it."""
    return left == right or left.startswith(right + "/") or right.startswith(left + "/")


def diff(left: Column, right: Column) -> Column:
    """Differences of two JSON texts: path, kind, and both values; the root's path is ``/``.  None without two texts, null where one is malformed."""

    def compare(path: str, a: object, b: object, out: list) -> None:
        if canonical(a) == canonical(b):
            return
        if isinstance(a, dict) and isinstance(b, dict):
            for key in sorted({*a, *b}):
                at = f"{path}/{key.replace('~', '~0').replace('/', '~1')}"
                if key not in b:
                    out.append((at, "removed", canonical(a[key]), None))
                elif key not in a:
                    out.append((at, "added", None, canonical(b[key])))
                else:
                    compare(at, a[key], b[key], out)
        elif isinstance(a, list) and isinstance(b, list):
            for i in range(max(len(a), len(b))):
                if i >= len(b):
                    out.append((f"{path}/{i}", "removed", canonical(a[i]), None))
                elif i >= len(a):
                    out.append((f"{path}/{i}", "added", None, canonical(b[i])))
                else:
                    n = len(out)
                    compare(f"{path}/{i}", a[i], b[i], out)
                    if len(out) == n and canonical(a[i]) != canonical(b[i]):
                        out.append((f"{path}/{i}", "array_item_changed", canonical(a[i]), canonical(b[i])))
        else:
            base = lambda v: "number" if isinstance(v, Number) else kind(v)
            out.append((path or "/", "value_changed" if base(a) == base(b) else "type_changed", canonical(a), canonical(b)))

    def both(a: str | None, b: str | None) -> list | None:
        out: list = []
        try:
            if a is not None and b is not None:
                compare("", parse(a), parse(b), out)
        except (ValueError, RecursionError):
            return None
        return out

    return each(both, "array<struct<path:string,kind:string,baseline:string,candidate:string>>", left, right)


#: Members that name an array's items, the first that all have.
ITEM_KEYS = ("id", "sku", "product_code", "code")


def _item_key(items: list) -> str | None:
    named = lambda k: all(isinstance(x, dict) and isinstance(x.get(k), str) for x in items)
    return next((k for k in ITEM_KEYS if items and named(k)), None)


def _rows(value: object, path: str, out: dict) -> None:
    """Ends of a document by path: type and text; an empty object or array is an end."""
    inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
    if not inner:
        out[path] = kind(value), canonical(value)
    for step, x in inner:
        _rows(x, f"{path}/{str(step).replace('~', '~0').replace('/', '~1')}", out)


def _aligned(expected: object, actual: object, path: str, out: dict) -> None:
    """As ``_rows`` for the actual document, items of named arrays at the places of the expected ones."""
    if isinstance(expected, dict) and isinstance(actual, dict) and actual:
        for step, x in actual.items():
            _aligned(expected.get(step, MISSING), x, f"{path}/{step.replace('~', '~0').replace('/', '~1')}", out)
    elif isinstance(expected, list) and isinstance(actual, list) and actual and (key := _item_key(expected + actual)):
        places = {str(x[key]): i for i, x in reversed(list(enumerate(expected)))}
        more = len(expected)
        for x in actual:
            at = places.get(str(x[key]))
            if at is None:
                at, more = more, more + 1
            _rows(x, f"{path}/{at}", out)
    else:
        _rows(actual, path, out)


def structural_diff(expected: Column, actual: Column) -> Column:
    """Every end of two documents: path, state (unchanged, changed, type_changed, added, removed) and both texts.

    Items of arrays that all have a member of ``ITEM_KEYS`` are compared by it, others by place.
    Null if either document is null or malformed.
    """

    def compare(left: str | None, right: str | None) -> list | None:
        try:
            e, a = (None if x is None else parse(x.strip()) for x in (left, right))
            if left is None or right is None:
                return None
            was: dict = {}
            now: dict = {}
            _rows(e, "", was)
            _aligned(e, a, "", now)
        except (ValueError, RecursionError):
            return None
        out = []
        for path in sorted({*was, *now}):
            b, c = was.get(path), now.get(path)
            state = "added" if b is None else "removed" if c is None else "unchanged" if b == c else "changed" if b[0] == c[0] else "type_changed"
            out.append((path, state, b and b[1], c and c[1]))
        return out

    return each(compare, "array<struct<path:string,state:string,expected:string,actual:string>>", expected, actual)


def redact(text: Column, pointers: list[str], mark: str = "[redacted]") -> Column:
    """Canonical JSON text with the values at the pointers replaced; pointers that lead nowhere change nothing.  Null for malformed texts: nothing of them is shown."""

    def hide(raw: str | None) -> str | None:
        try:
            value = parse(raw or "")
        except (ValueError, RecursionError):
            return None
        for pointer in pointers:
            if not pointer:
                return json.dumps(mark)
            parent, _, last = pointer.rpartition("/")
            inside = resolve(value, parent)
            if resolve(value, pointer) is not MISSING:
                last = last.replace("~1", "/").replace("~0", "~")
                inside[int(last) if isinstance(inside, list) else last] = mark
        return canonical(value)

    return each(hide, "string", text)


def json_items(text: Column) -> Column:
    """The items of a JSON array as canonical texts; another value is its own only item; null for malformed texts."""

    def split(raw: str | None) -> list[str] | None:
        try:
            value = parse((raw or "").strip())
        except (ValueError, RecursionError):
            return None
        return [canonical(x) for x in value] if isinstance(value, list) else [canonical(value)]

    return each(split, "array<string>", text)
