"""Personal data: proposed by patterns, confirmed by check digits, weighed by context (operator 4)."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from cadastra.llm.common import batches, bound_batches, narrow, texts

#: Kinds in the order of the results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
# Possessive repeats and a look-behind keep each pattern linear on long runs; the matches are those of the plain patterns.
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "number"),
}
#: Prior weight of a confirmed span of each kind, and what context adds.
PRIOR, NEAR, REACH = {"email": 0.95, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.95, "ssn": 0.4}, 0.3, 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards in linear time."""
    out, floor, at = [], 0, text.find("@")
    ok = LOCAL_END.match
    while at >= 0:
        begin = at
        while begin > floor and ok(text, begin - 1):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    return out


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Confirmed spans (kind, start, end, score), by kind, then start; code points, end exclusive."""
    out: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        a, b = m.span()
        if b - a >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", a, b))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    base = [x[1:] for x in out]
    free = lambda a, b: all(b <= x or y <= a for x, y in base)
    for m in IBAN.finditer(text):  # the longest head that passes; letters after it may be the next word
        parts = m[0].split(" ")
        for n in range(len(parts), 0, -1):
            if mod97("".join(parts[:n])):
                out.append(("iban", m.start(), m.start() + len(" ".join(parts[:n]))))
                break
    near = lambda kind, a, b: _near(text, kind, a, b)
    if "-" in text:
        out += [("ssn", *m.span()) for m in SSN.finditer(text) if free(*m.span()) and near("ssn", *m.span())]
    return [(k, a, b, min(1.0, PRIOR[k] + (NEAR if near(k, a, b) else 0.0))) for k, a, b in out]


def _near(text: str, kind: str, a: int, b: int) -> bool:
    around = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", f"{text[max(0, a - REACH) : a]} {text[b : b + REACH]}".lower()))
    return not around.isdisjoint(CONTEXT[kind])


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans count as one, by the first."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, with_masked: bool = False) -> DataFrame:
    """Spans of each row of docs(doc_id, text): counts by base kind, spans as structs and as text.

    Narrow, one pass over whole texts. Null and empty texts have no spans; repeated rows give repeated results;
    an empty table gives an empty one; extra columns are ignored; very long runs of digits, letters or @ stay linear.
    """
    bound_batches(docs.sparkSession)
    join = lambda spans: ",".join([f"{k}:{a}:{b}" for k, a, b, _ in spans])

    def run(it):
        for b in batches(it):
            text = texts(b.column(1))
            found = [find_spans(t) for t in text]
            of = lambda kind: pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64())  # noqa: B023, E731
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            columns = {
                "doc_id": b.column(0), **{f"n_{k}": of(k) for k in KINDS},
                "base_sha256": pa.array([hashlib.sha256(join([s for s in f if s[0] in KINDS[:4]]).encode()).hexdigest() for f in found]),
                "spans": pa.array([join(f) for f in found]),
                "found": pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in f] for f in found], pa.list_(kind)),
            } | ({"masked": pa.array([masked(t, f) for t, f in zip(text, found)], pa.string())} if with_masked else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint,score:double>>" + (", masked string" if with_masked else "")
    return narrow(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, schema)
