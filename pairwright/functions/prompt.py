"""Prompts from templates: compiled to one expression over the parts of a case that a system may see."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.json import json_string, read_json

#: Parts of a case that a template may name; references and evaluator's metadata are none of them.
VISIBLE = ("input", "model_visible_metadata")
_HOLE = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.DOTALL)
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)((?:\.[A-Za-z_][A-Za-z0-9_]*|\[[0-9]+\])*)")


def holes(template: str) -> list[tuple[str, str]]:
    """The parts and pointers that a template names, ``{{ input.a[0] }}`` as ``("input", "/a/0")``; anything else in braces is refused."""
    found = []
    for text in _HOLE.findall(template):
        named = _NAME.fullmatch(text)
        if named is None:
            raise ValueError(f"a template holds names, with members and places in them: {text!r}")
        if named[1] not in VISIBLE:
            raise ValueError(f"a template sees {VISIBLE} alone: {named[1]!r}")
        found.append((named[1], "".join("/" + step for step in re.findall(r"[A-Za-z0-9_]+", named[2]))))
    if "{{" in _HOLE.sub("", template) or "}}" in _HOLE.sub("", template):
        raise ValueError("braces of a template come in pairs")
    return found


def prompt(template: str) -> Column:
    """A struct of the prompt and what it lacks (part and pointer), over columns of the parts as JSON texts.

    A string goes in as its text, another value as JSON.  Nothing stands for what isn't there: then the
    prompt is null and ``undefined`` tells the first name that leads nowhere.
    """
    named = list(dict.fromkeys(holes(template)))
    read = {part: read_json(F.col(part), [p for q, p in named if q == part]) for part in dict.fromkeys(q for q, _ in named)}
    value = {(q, p): F.get(read[q]["found"], F.lit([y for x, y in named if x == q].index(p))) for q, p in named}
    text = lambda v: F.coalesce(json_string(v), v)
    pieces, upto = [], 0
    for hole, at in zip(_HOLE.finditer(template), holes(template), strict=True):
        pieces += [F.lit(template[upto : hole.start()]), text(value[at])]
        upto = hole.end()
    lacking = F.coalesce(*(F.when(v.isNull(), F.lit(f"{q}{p}")) for (q, p), v in value.items()), F.lit(None).cast("string"))
    return F.struct(F.concat(*pieces, F.lit(template[upto:])).alias("text"), lacking.alias("undefined"))
