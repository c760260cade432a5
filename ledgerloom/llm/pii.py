"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: The kinds whose spans are always kept, in the order in which spans are listed; then the others.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "short_card", "local_phone")
#: Spans of the other kinds need this score.
LEAST_SCORE = 0.5
#: Context: so many characters on either side of a span.
REACH = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that is followed by no dot fails from each of its digits alike: only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: Words near a span that speak for its kind, and words that speak against any kind.
_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|payment|cvv)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|cell)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer|konto)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security)\b", re.I),
}
_FOR |= {"short_card": _FOR["card"], "local_phone": _FOR["phone"]}
_AGAINST = re.compile(r"\b(?:example|sample|test|dummy|invoice|order|isbn|version)\b", re.I)
_START = {
    "email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "short_card": 0.4, "local_phone": 0.4,
}


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if at % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: country and check digits moved to the end, letters as 10 to 35."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @ outwards: a long run of
    letters without one costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_PART:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            free = end.end()
        at = text.find("@", max(at + 1, free))


def _base_spans(text: str):
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        # Lengths first: a part may have any number of digits.
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


def _more_spans(text: str):
    for m in _IBAN.finditer(text):
        if 15 <= len(account := m[0].replace(" ", "")) <= 34 and mod97(account):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 15 and luhn(digits):
            yield "short_card", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}"
    score = _START[kind] + 0.3 * bool(_FOR[kind].search(near)) - 0.2 * bool(_AGAINST.search(near))
    return round(min(1.0, max(0.0, score)), 2)


_DIGIT = re.compile(r"[0-9]")


def spans_of(text: str) -> list[dict]:
    """The spans of one text, by kind as listed, then by start. Positions count code points, the end is exclusive."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    base = [(kind, start, end, _score(text, kind, start, end)) for kind, start, end in _base_spans(text)]
    more = []
    for kind, start, end in _more_spans(text):
        if any(start < b and a < end for _, a, b, _ in base):
            continue
        if (score := _score(text, kind, start, end)) >= LEAST_SCORE:
            more.append((kind, start, end, score))
    return [dict(zip(("kind", "start", "end", "score"), span)) for span in base + more]


_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)


def pii_spans(text: Column) -> Column:
    """Spans of personal data in a text column: kind, start, end, score.

    E-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers are always reported;
    their score says how much the context supports them. International account numbers (mod 97), social security
    numbers, cards of 13 to 15 digits (Luhn) and phone numbers without a country code are reported where they do not
    overlap the former and context lifts their score to 0.5. Null and empty texts have no spans; a text is searched
    whole, in time proportional to its length.
    """

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t) if t else [] for t in texts.to_pylist()], _TYPE)

    return find(text)


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as text: kind:start:end, comma-joined in their order."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
