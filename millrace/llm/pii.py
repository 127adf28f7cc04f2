"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds, leftmost and non-overlapping per kind over the whole text: email, ip (parts at most 255), card (13 to 19
digits, Luhn), phone (9 to 15 digits). A base span that passes its validator is always kept. More kinds are proposed and
kept only if the score reaches ``threshold``: iban (as long as its country's are; mod-97 confirms: 0.9), ssn (no checksum: 0.4, so it needs
a context word) and secret (a run of 20 or more characters of keys and tokens, letters and digits, that an entropy of ``BITS`` a
character confirms: 0.4, or 0.9 with a known prefix). A whole context word within ``reach`` characters before or after adds 0.2.

Null text counts as empty. A null doc_id is returned as null. Repeated rows give repeated results. Offsets are code
points, end exclusive. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive, and only from the start of a run of digits (no match ends inside one): linear in the text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: Lengths of IBANs by country, as published in the registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN_REST = {n: re.compile(r"(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}")
#: Beginnings of keys and tokens that their makers have published.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ")
BITS = 3.0
NOT_DIGIT = re.compile(r"[^0-9]")
#: Context words by kind, lower case.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"), "iban": ("iban", "bank", "account", "transfer"), "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("token", "key", "secret", "password", "passwd", "credential", "credentials", "bearer", "auth", "apikey", "api"),
}
NEARBY = {kind: re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})(?![^\W_])") for kind, words in CONTEXT.items()}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.4}


def entropy(text: str) -> float:
    """Bits a character by the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")  # first, as int() refuses long runs of digits
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text.replace(" ", "")
    moved = moved[4:] + moved[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each '@' is tried once: the local part is the run of its characters before it, after the last match."""
    found, last, at, seen = [], 0, text.find("@"), 0
    while at >= 0:
        start = at
        while start > seen and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end()))
            last = m.end()
        seen = max(last, at + 1)  # characters before this '@' can't belong to a later local part
        at = text.find("@", max(at + 1, last))
    return found


def spans_of(text: str, reach: int = 40, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    found: list[tuple[str, int, int, float]] = []

    def scored(kind: str, start: int, end: int, base: float | None = None) -> None:
        around = (text[max(0, start - reach) : start] + " " + text[end : end + reach]).lower()
        score = min(1.0, (SCORE[kind] if base is None else base) + 0.2 * bool(NEARBY[kind].search(around)))
        if kind in BASE or score >= threshold:
            found.append((kind, start, end, round(score, 2)))

    if "@" in text:
        for s, e in emails(text):
            scored("email", s, e)
    for m in IP.finditer(text):
        if all(map(byte_sized, m.group().split("."))):
            scored("ip", *m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            scored("card", *m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                scored("phone", *m.span())
    for m in IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[1])
        if n and (rest := IBAN_REST[n].match(text, m.end())) and mod97(text[m.start() : rest.end()]):
            scored("iban", m.start(), rest.end())
    for m in SSN.finditer(text):
        scored("ssn", *m.span())
    for m in SECRET.finditer(text):
        run = m.group().rstrip("=")
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and entropy(run) >= BITS:
            scored("secret", *m.span(), 0.9 if run.startswith(PREFIXES) else None)
    return found


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame, reach: int = 40, threshold: float = 0.6) -> DataFrame:
    """doc_id and its spans (kind, start, end, score), by kind, then start."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t, reach, threshold)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))

