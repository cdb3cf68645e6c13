"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, URL schemes and identifier cues; local parsers then expand each anchor to the left and right
and validate the e-mail address, URL or account number around it. Numbers (IPv4 addresses, card numbers) start at digit runs, which are their
own anchors. Every parser is linear in the text, so very long texts cost no more for each character.

Kinds, in the order of all lists: email, ip, card, phone (the base kinds), then what the method adds: ssn (nnn-nn-nnnn with valid parts),
iban (from the country code to that country's length, check digits verified; for codes outside IBAN_LENGTH the longest valid 15 to 34
characters that end with a group), url (http, https or ftp, and www.) and account (a digit string of 6 or more behind a cue such as "account no").
Spans count code points, end exclusive; spans of one kind don't overlap.

Nulls: a null text is empty and has no spans; a null key stays null. Repeated rows give repeated results. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "url", "account")
Span = tuple[int, int, int]  # number of the kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_URL = re.compile(r"[^\x00-\x20\x7f<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
_GROUP_END = re.compile(r"[A-Z0-9](?![A-Z0-9])")
#: Characters of an IBAN by country, as registered.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_OF_LENGTH = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}") for n in set(IBAN_LENGTH.values())}
_AFTER_CUE = re.compile(r"[\x20.:#=]*(?:(?:no|nr|number|num)\b[\x20.:#=]*)?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
_CUES = ("account", "acct", "konto", "cuenta", "compte")
_SCHEMES = ("http://", "https://", "ftp://", "www.")
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLE[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int | None:
    """Where the IBAN ends whose country code and check digits are at start."""
    if n := IBAN_LENGTH.get(text[start : start + 2]):
        m = _OF_LENGTH[n].match(text, start + 4)
        return m.end() if m and iban_valid(text[start : m.end()]) else None
    if m := _IBAN_REST.match(text, start + 4):
        for end in reversed([g.end() for g in _GROUP_END.finditer(text, start + 4, m.end())]):
            if iban_valid(text[start:end]):
                return end
    return None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, what in [("@", "email"), ("+", "phone"), *((s, "url") for s in _SCHEMES), *((c, "account") for c in _CUES)]:
        found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


_ANCHORS = None


def anchors(text: str) -> list[tuple[int, tuple[str, int]]]:
    """(last position, (what, length)) of every anchor, case ignored."""
    global _ANCHORS
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    low = text.lower()
    return list(_ANCHORS.iter(low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)))


def find(text: str) -> list[Span]:
    """All spans of a text, by kind and then start."""
    emails: list[Span] = []
    phones: list[Span] = []
    urls: list[Span] = []
    accounts: list[Span] = []
    email_end = phone_end = url_end = account_end = 0
    for last, (what, n) in anchors(text):
        if what == "email":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                emails.append((0, start, email_end))
        elif what == "phone":
            if last >= phone_end and (m := _PHONE.match(text, last + 1)):
                phone_end = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    phones.append((3, last, phone_end))
        elif what == "url":
            start = last - n + 1
            if start >= url_end and (m := _URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]*":
                    end -= 1
                if "." in text[last + 1 : end] or what == "url" and n > 4 and end > last + 1:
                    url_end = end
                    urls.append((6, start, end))
        elif last + 1 > account_end and (m := _AFTER_CUE.match(text, last + 1)):
            account_end = m.end(1)
            accounts.append((7, m.start(1), account_end))
    out = emails
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    out += phones
    out += ((4, m.start(), m.end()) for m in _SSN.finditer(text))
    last_iban = 0
    for m in _IBAN.finditer(text):
        if m.start() >= last_iban and (end := iban_end(text, m.start())):
            last_iban = end
            out.append((5, m.start(), end))
    out += urls
    out += accounts
    return out


def joined(spans: Iterable[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{start}:{end}" for k, start, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of spans that overlap, replaced by the upper-case kind of its first one in brackets."""
    out: list[str] = []
    at = 0
    merged: list[list[int]] = []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += (text[at:start], f"[{KINDS[kind].upper()}]")
        at = end
    return "".join((*out, text[at:]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the spans found: kind, start_, end_ in the order of KINDS and start. Narrow, no shuffle."""

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            yield k, [(KINDS[kind], start, end) for kind, start, end in find(t or "")]

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), rows, f"`{key}` {kind}, spans array<struct<kind:string,start_:long,end_:long>>")


def scan_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, base_sha256 and spans as one string; the same find() as scan()."""

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            spans = find(t or "")
            base = [s for s in spans if s[0] < len(BASE)]
            yield k, *(sum(s[0] == i for s in base) for i in range(len(BASE))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), rows, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every span of text replaced; null texts stay null. length: a column to hold the new number of code points, if docs has it."""
    at = docs.columns.index(text)
    at_n = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t and redact(t, find(t)) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if at_n is not None:
                    columns[at_n] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[at_n].to_pylist())], part.schema.field(at_n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
