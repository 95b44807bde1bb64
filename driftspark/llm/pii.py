"""Personal data in texts: patterns propose spans, checksums confirm them, and
words nearby move the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are kept
whenever their own check holds; context only moves their score. Further kinds
(iban, ssn, birth) are kept from MIN_SCORE on. Each pattern is scanned in time
linear in the text, also over long runs of digits or letters.

Null texts count as empty. Repeated rows are scanned on their own. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "birth")
N_BASE = 4
MIN_SCORE = 0.6
NEAR = 48  # characters before and after a span that are searched for context

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
BIRTH = re.compile(r"(?<![0-9])(?:[12][09][0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./][12][09][0-9]{2})(?![0-9])")

# Characters of an IBAN by country, after the SWIFT registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# What a confirmed match scores alone.
PRIOR = {"email": 0.95, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "birth": 0.3}
# Words that raise the score of a kind when they stand near; words that lower it.
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "birth": ("born", "birth", "dob", "geboren", "nacimiento", "naissance", "né", "née"),
}
AGAINST = ("version", "isbn", "build", "example", "release", "order", "invoice")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost, non-overlapping: the local part is the run before an ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, m = at, DOMAIN.match(text, at + 1)
        while m and start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ibans(text: str):
    """The pattern may run on into what follows, so the search goes on at the
    end of the confirmed span, or just after the start of a refused one."""
    m = IBAN.search(text)
    while m:
        want, end, seen = IBAN_LENGTH.get(m[1], 0), m.start(), 0
        while seen < want and end < m.end():
            seen += text[end] != " "
            end += 1
        after = text[end:end + 1]
        if seen == want > 0 and not (after.isalnum() and after.isascii()) and mod97(text[m.start():end].replace(" ", "")):
            yield "iban", m.start(), end
        else:
            end = m.start() + 1
        m = IBAN.search(text, end)


def proposals(text: str):
    """(kind, start, end) of every match that its checksum or range confirms."""
    for s, e in emails(text):
        yield "email", s, e
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield "phone", *m.span()
    yield from ibans(text)
    for kind, pattern in (("ssn", SSN), ("birth", BIRTH)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    words = {w.lower() for w in WORD.findall(text[max(0, start - NEAR):start] + " " + text[end:end + NEAR])}
    s = PRIOR[kind] + 0.4 * any(w in words for w in FOR[kind]) - 0.2 * any(w in words for w in AGAINST)
    return round(min(1.0, max(0.0, s)), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in proposals(text)]
    found = [x for x in found if KINDS.index(x[0]) < N_BASE or x[3] >= MIN_SCORE]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``pii``, an array of (kind, start, end, score)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    names = ("kind", "start", "end", "score")
    return add_columns(df, [text], lambda texts: [[[dict(zip(names, x)) for x in find(t)] for t in texts]],
                       [T.StructField("pii", T.ArrayType(span))])


def digest(spans: list[dict]) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    def rows(found):
        base = [[x for x in spans if x["kind"] in KINDS[:N_BASE]] for spans in found]
        counts = [[sum(x["kind"] == k for x in b) for b in base] for k in KINDS[:N_BASE]]
        return [*counts, [sha256(digest(b).encode()).hexdigest() for b in base], [digest(s) for s in found]]

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:N_BASE]),
              T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    return add_columns(found, ["pii"], rows, fields).drop("pii")
