"""Secret scans: patterns propose candidates, and their structure has to confirm them.

Tokens are reported only if their base64 or hexadecimal decodes to something with a
form: a DER sequence whose nested lengths add up, an SSH key blob whose fields fill it,
or a signed or encrypted token whose header is a JSON object that names its algorithms.
Base64 may be wrapped into lines of one width, hexadecimal may be in either case.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "ssh", "der")
BASE = KINDS[:3]

#: The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
_WORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
#: Patterns that the method adds.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]*+){2,}+")
_PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:\s|\\[nr])*+Proc-Type: 4,ENCRYPTED(?:\s|\\[nr])++DEK-Info: [A-Z0-9-]++,[0-9A-Fa-f]++(?:\s|\\[nr])++)?+"
    r"((?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END \1PRIVATE KEY-----"
)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}(?![A-Za-z0-9+/_=-])")
_LINE = re.compile(r"\r?\n[\x20\t]*+([A-Za-z0-9+/_-]++)(={0,2}+)")
_EITHER_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}+(?![0-9A-Fa-f])")


def decoded(text: str) -> bytes | None:
    """What base64 in either alphabet, padded or not, decodes to; None if it isn't that."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """A DER length and where its content begins."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


#: Constructed elements may be nested so deep.
DEEPEST = 16


def _elements(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the DER elements that fill the range, constructed ones filled in turn; None if their lengths don't add up."""
    tags = []
    while at < end:
        tags.append(data[at])
        if (part := _length(data, at + 1)) is None or part[0] + part[1] > end:
            return None
        at = part[0] + part[1]
        if tags[-1] & 0x20 and (depth == DEEPEST or _elements(data, part[1], at, depth + 1) is None):
            return None
    return tags


def is_der(data: bytes) -> bool:
    """A SEQUENCE that fills the data, whose elements fill it in turn, all the way down; an INTEGER or SEQUENCE first."""
    if len(data) < 24 or data[0] != 0x30 or (head := _length(data, 1)) is None or head[0] + head[1] != len(data):
        return False
    tags = _elements(data, head[1], len(data))
    return tags is not None and len(tags) >= 2 and tags[0] in (0x02, 0x30)


def _fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill the data; None if they don't."""
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return None
        fields.append(data[at - n : at])
    return fields if at == len(data) else None


def is_ssh(data: bytes) -> bool:
    """A public key: fields that fill the data, the first a name of a key's kind; or an openssh private one, its fields nested likewise."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        fields = _fields(data)
        return fields is not None and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))
    # Cipher, key derivation and its options, the number of keys, each public key, and the private part.
    at, names = len(magic), []
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        names.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    n_keys = int.from_bytes(data[at : at + 4], "big")
    rest = _fields(data[at + 4 :]) if at + 4 <= len(data) else None
    return rest is not None and 1 <= n_keys == len(rest) - 1 and bool(names[0]) and all(is_ssh(key) and not key.startswith(magic) for key in rest[:-1])


def _object(part: str) -> dict | None:
    """The JSON object that a part of a token decodes to, in whatever way it is written."""
    try:
        found = json.loads(decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(parts: list[str]) -> bool:
    """Three parts, header and body JSON objects, the header naming an algorithm; or five, the header naming two, the other parts base64."""
    if len(parts) not in (3, 5) or (header := _object(parts[0])) is None or not isinstance(header.get("alg"), str):
        return False
    if len(parts) == 3:
        return _object(parts[1]) is not None
    return isinstance(header.get("enc"), str) and bool(parts[3]) and all(decoded(p) is not None for p in parts[1:])


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    for m in _TOKEN.finditer(text):
        parts = m[0].split(".")
        while len(parts) > 3 and not parts[-1]:  # the end of a sentence
            parts.pop()
        if is_token(parts):
            yield m.start(), m.start() + len(".".join(parts))


def _confirmed(text: str) -> str | None:
    data = decoded(text)
    return ("ssh" if is_ssh(data) else "der" if is_der(data) else None) if data else None


def _keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 of key encodings: in one piece, or in lines of one width and a last one that isn't longer."""
    upto = 0
    for m in _BASE64.finditer(text):
        if m.start() < upto:
            continue
        if kind := _confirmed(m[0]):
            yield kind, *m.span()
            continue
        head = decoded(m[0][:40]) if text[m.end() : m.end() + 1] in ("\r", "\n") and "=" not in m[0] else None
        if not head or not head.startswith((b"\x30", b"\0\0\0", b"openssh-key-v1\0")):
            continue
        parts, ends = [m[0]], [m.end()]
        while (line := _LINE.match(text, ends[-1])) and len(line[1]) <= len(m[0]):
            parts.append(line[0].strip())
            ends.append(line.end())
            if len(line[1]) < len(m[0]) or line[2]:
                break
        # The last line may be what comes after a block of full lines.
        for n in (len(parts), len(parts) - 1):
            if n > 1 and (kind := _confirmed("".join(parts[:n]))):
                yield kind, m.start(), ends[n - 1]
                break
        upto = ends[-1]


def _private(m: re.Match) -> bool:
    """A private key's block: DER or SSH; with the headers of an encrypted one, whole blocks of its cipher."""
    data = decoded("".join(re.sub(r"\\[nr]", "", m[3]).split()))
    if m[2]:
        return bool(data) and len(data) % 8 == 0
    return bool(data) and (is_der(data) or is_ssh(data))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    text, found = text or "", []
    if _WORDS.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [("jwt", *span) for span in _tokens(text)]
    if "-----BEGIN" in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if _private(m)]
    found += _keys(text)
    spelled = {m.span() for m in _EITHER_HEX.finditer(text)} | {(a, b) for kind, a, b in found if kind == "hex" and (b - a) % 2 == 0}
    found += [("der", a, b) for a, b in spelled if is_der(bytes.fromhex(text[a:b]))]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_secrets(docs: DataFrame, *, text_col: str = "text", as_col: str = "secrets") -> DataFrame:
    """The documents with their secrets: kind, start, end (code points) and text.  Null texts have none."""
    kind = "array<struct<kind:string,start:long,end:long,text:string>>"
    return docs.withColumn(as_col, F.udf(lambda text: [(k, a, b, text[a:b]) for k, a, b in spans(text)], kind, useArrow=True)(F.col(text_col)))


def secret_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and list of all spans, one row per document."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            rows = [spans(text) for text in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(s[0] == kind for s in r) for r in rows], pa.int64())  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(count, BASE), pa.array([hashlib.sha256(listed([s for s in r if s[0] in BASE]).encode()).hexdigest() for r in rows]), pa.array([listed(r) for r in rows])],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")
