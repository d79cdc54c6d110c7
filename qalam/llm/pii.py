"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = KINDS[:4]
#: Score of a span before its context is read: what its validator alone proves.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.95}
CONTEXT_CHARS = 40
CONTEXT_STEP = 0.2

# fixed values: words that speak for a kind, and words that speak against personal data
CONTEXT = {
    "email": ["email", "e-mail", "mail", "contact", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "login", "adresse"],
    "card": ["card", "visa", "mastercard", "payment", "credit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
}
AGAINST = ["example", "sample", "version", "isbn", "order", "invoice", "serial"]
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive runs that start where a run of digits starts: the same leftmost
# matches as the plain patterns, in linear time on endless digit runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # the local part holds no @, so each match ends its local run at an @
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    # a grouped number may be followed by a capital word: cut at the country's length
    for m in _IBAN.finditer(text):
        length, seen, raw = IBAN_LENGTHS.get(m.group()[:2], 0), 0, ""
        for i, c in enumerate(m.group()):
            if c != " ":
                raw, seen = raw + c, i + 1
            if len(raw) == length:
                break
        end = m.start() + seen
        if length and len(raw) == length and not text[end:end + 1].isalnum() and mod97(raw):
            yield m.start(), end


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - CONTEXT_CHARS):start])}
    near |= {w.lower() for w in _WORDS.findall(text[end:end + CONTEXT_CHARS])}
    score = PRIOR[kind] + CONTEXT_STEP * any(w in near for w in CONTEXT[kind])
    return round(min(1.0, max(0.0, score - CONTEXT_STEP * any(w in near for w in AGAINST))), 2)


def find_spans(text: str | None) -> list[Span]:
    """All confirmed spans of a text by start, then kind; a null text has none."""
    if not text:
        return []
    out = [Span(k, s, e, _score(k, text, s, e)) for k, f in _FINDERS.items() for s, e in f(text)]
    return sorted(out, key=lambda x: (x.start, KINDS.index(x.kind)))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at:x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id and ``spans``, an array of (kind, start, end, score).

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans; repeated rows and null ids stay. Other columns are not read.
    """
    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": x.kind, "start": x.start, "end": x.end, "score": x.score} for x in find_spans(t)]
                          for t in texts], dtype=object)

    return docs.select(F.col(id_col), spans(F.col(text_col)).alias("spans"))


def redact_documents(docs: DataFrame, min_score: float = 0.5, text_col: str = "text",
                     chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every confirmed span replaced by its kind, of the added kinds those of at least ``min_score``.

    All columns stay; ``chars_col``, where there is one, follows the new text.
    Null texts stay null.
    """
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [x for x in find_spans(t) if x.kind in BASE or x.score >= min_score])
                          for t in texts], dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return out


def base_spans(spans: str) -> object:
    """The spans of the base kinds in an array column of :func:`scan`."""
    return F.filter(spans, lambda x: x["kind"].isin(BASE))


def joined(spans: object) -> object:
    """An array of spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
