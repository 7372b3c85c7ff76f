"""Whether a JSON value stands anywhere in a document: one hash per subtree, made from those of its parts."""

from __future__ import annotations

import json
from hashlib import blake2b

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.json import Number, each, parse

TREES = "array<struct<pointer:string,type:string,hash:binary>>"


def _walk(value: object, path: str, out: list) -> bytes:
    """The hash of a value, after those of all its parts; keys in any order give the same, numbers count as written."""
    if isinstance(value, dict):
        parts = [json.dumps(k).encode() + b":" + _walk(value[k], f"{path}/{k.replace('~', '~0').replace('/', '~1')}", out) for k in sorted(value)]
        kind, text = "object", b"{" + b",".join(parts)
    elif isinstance(value, list):
        kind, text = "array", b"[" + b",".join(_walk(x, f"{path}/{i}", out) for i, x in enumerate(value))
    elif isinstance(value, Number):
        kind, text = "number", b"#" + value.encode()
    else:
        kind, text = ("string" if isinstance(value, str) else "null" if value is None else "boolean"), json.dumps(value).encode()
    found = blake2b(text, digest_size=16).digest()
    out.append((path, kind, found))
    return found


def subtrees(text: Column) -> Column:
    """Every value of a document with its pointer, type and hash, parts before wholes; an empty array for null and malformed texts."""

    def trees(raw: str | None) -> list:
        out: list = []
        try:
            _walk(parse((raw or "").strip()), "", out)
        except (ValueError, RecursionError):
            return []
        return out

    return each(trees, TREES, text)


def contains(document: Column, value: Column) -> Column:
    """Whether the value is the document or stands anywhere in it; both are JSON texts, null where either is none."""
    whole, trees = F.try_element_at(subtrees(value)["hash"], F.lit(-1)), subtrees(document)["hash"]
    return F.when((F.size(trees) > 0) & whole.isNotNull(), F.array_contains(trees, whole))


def held(gold: Column, seen: Column) -> Column:
    """Pointers of a document's values that stand anywhere in another, each the largest there: what lies inside one isn't told again.

    Both are arrays of ``subtrees``.  Nulls and empty objects and arrays tell nothing and are left out.
    """
    hashes = seen["hash"]
    empty = [blake2b(x, digest_size=16).digest() for x in (b"null", b"{", b"[")]
    there = F.filter(gold, lambda t: F.array_contains(hashes, t["hash"]) & ~t["hash"].isin(empty))
    at = F.transform(there, lambda t: t["pointer"])
    return F.filter(at, lambda p: ~F.exists(at, lambda q: (q != p) & F.startswith(p, F.concat(q, F.lit("/")))))
