"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.scratch import trimmed

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

#: The base patterns.  Each is written so that no text makes it take more than linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Patterns that the method adds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9])*+")
#: How many characters an account number has, by country.
IBAN_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 "
    "GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 "
    "MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 SV:28 TL:23 TN:24 "
    "TR:26 UA:29 VA:22 VG:24 XK:20"
).split())
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Scores of a confirmed span before its context counts, and the words that count.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.35}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "amex", "mastercard", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "order", "part", "serial", "example")
RAISE, LOWER, NEAR = 0.2, 0.2, 40
#: Spans of added kinds count from this score on; base spans always count.
LEAST = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = ord(digit) - 48
        total += n if place % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in bare[4:] + bare[:4])
    return int(number) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, single spaces allowed; what follows may be capitals after a space."""
    for m in _IBAN.finditer(text):
        length = int(IBAN_LENGTHS.get(m[0][:2], 0))
        rest = _IBAN_REST.match(text, m.end(), m.end() + 2 * 34)[0]
        at = n = 0
        while at < len(rest) and n < length - 4:
            n += rest[at] != " "
            at += 1
        end = m.end() + at
        if n == length - 4 and not text[end : end + 1].isalnum() and mod97(text[m.start() : end]):
            yield m.start(), end


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _ssn(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end) in code points, by kind and then by start."""
    if "@" in text:
        yield from (("email", *span) for span in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    yield from (("iban", *span) for span in _ibans(text))
    for m in _SSN.finditer(text):
        if _ssn(m[0]):
            yield "ssn", *m.span()


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def spans(text: str | None) -> list[Span]:
    """All spans that count, by kind and then by start."""
    found = []
    for kind, start, end in candidates(text or ""):
        near = re.findall(r"[a-z-]+", f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower())
        score = PRIOR[kind] + RAISE * any(w in CONTEXT[kind] for w in near) - LOWER * any(w in AGAINST for w in near)
        if kind in BASE or score >= LEAST:
            found.append(Span(kind, start, end, round(min(max(score, 0.0), 1.0), 3)))
    return found


def listed(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def masked(text: str | None, found: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    if not found:
        return text
    out, upto = [], 0
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if s.start >= upto:
            out += [text[upto : s.start], f"<{s.kind.upper()}>"]
        upto = max(upto, s.end)
    return "".join([*out, text[upto:]])


def find_pii(docs: DataFrame, *, text_col: str = "text", as_col: str = "pii") -> DataFrame:
    """The documents with their spans: kind, start, end (code points), score and text.  Null texts have none."""
    kind = "array<struct<kind:string,start:long,end:long,score:double,text:string>>"
    with_text = F.udf(lambda text: [(s.kind, s.start, s.end, s.score, text[s.start : s.end]) for s in spans(text)], kind, useArrow=True)
    return docs.withColumn(as_col, with_text(F.col(text_col)))


def mask_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents, their personal data replaced by the kind's name.  Null texts stay null."""

    def hidden(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([masked(text, spans(text)) for text in batch.to_pylist()], pa.string())

    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.functions import ArrowUDFType

    return docs.withColumn(text_col, arrow_udf(lambda it: trimmed(hidden(it)), "string", ArrowUDFType.SCALAR_ITER)(F.col(text_col)))


def pii_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and list of all spans, from ``find_pii``'s spans in the same pass.

    Base spans always count; ``scores`` gives each span's score, in the order of ``spans``, and
    ``confident`` lists the spans that their checks and context carry to LEAST.  A null text has none.
    """

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            rows = [spans(text) for text in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(s.kind == kind for s in r) for r in rows], pa.int64())  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(count, BASE), pa.array([hashlib.sha256(listed([s for s in r if s.kind in BASE]).encode()).hexdigest() for r in rows]), pa.array([listed(r) for r in rows]), pa.array([",".join(f"{s.score:.3f}" for s in r) for r in rows]), pa.array([listed([s for s in r if s.score >= LEAST]) for r in rows])],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores", "confident"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, scores string, confident string")
