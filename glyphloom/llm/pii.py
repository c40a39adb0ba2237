"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, schemes, digits
and identifier cues. At each anchor a small deterministic parser expands to the left and right and
validates what it finds:

* at-sign: email address (local part to the left, domain of two labels or more to the right)
* digit: dotted address of four numbers up to 255; card number of 14 to 19 digits that pass Luhn
* plus before a digit: phone number of 10 to 15 digits
* scheme ``://``: login, the ``user:password@`` of an address
* cue: ``secret`` after token, secret, password, passwd, api_key or apikey with ``=`` or ``:``, eight
  characters or more with a digit among them; ``account`` after iban, account, acct, ssn or passport,
  six characters or more with four digits among them, an IBAN only if its check digits are right

The first four kinds are the base kinds, each leftmost and non-overlapping on its own; the others
are added. Spans are counted in code points, end exclusive.

Defined results: null and empty texts have no spans; texts are read whole, whatever their length;
repeated rows are read as often as they occur. Redaction puts ``[KIND]`` in place of each span;
where spans overlap, the first, and of those the longest, is replaced and the rest of the others
along with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import made_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "account")
SPANS = "array<struct<kind: string, start: int, end: int>>"
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
NUMBER = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+(?=@)")
SECRET = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.~-]{8,})")
ACCOUNT = re.compile(r"(?:\s{1,3}(?:number|no\.?|num|id))?\s{0,3}[:=#]?\s{0,3}([A-Z]{0,2}[0-9][A-Z0-9]*(?:[ -][A-Z0-9]*[0-9][A-Z0-9]*)*)")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")


def luhn(digits: str) -> bool:
    other = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in other)) % 10 == 0


def iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return len(value) >= 15 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, done: int) -> Span | None:
    first = at
    while first > done and text[first - 1] in LOCAL:
        first -= 1
    m = DOMAIN.match(text, at + 1) if first < at else None
    return (first, m.end()) if m else None


def _login(text: str, at: int, done: int) -> Span | None:
    m = LOGIN.match(text, at + 3)
    return m.span() if m else None


def _secret(text: str, end: int, done: int) -> Span | None:
    m = SECRET.match(text, end)
    return m.span(1) if m and any(c.isdigit() for c in m[1]) else None


def _account(text: str, end: int, done: int) -> Span | None:
    m = ACCOUNT.match(text, end)
    if not m:
        return None
    bare = re.sub("[ -]", "", m[1])
    if bare[:2].isalpha():
        return m.span(1) if iban(bare) else None
    return m.span(1) if len(bare) >= 6 and sum(c.isdigit() for c in bare) >= 4 else None


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for digit in "0123456789":
        made.add_word(digit, ("digit", 1))
        made.add_word("+" + digit, ("plus", 2))
    made.add_word("@", ("at", 1))
    made.add_word("://", ("scheme", 3))
    for cues, what in ((SECRET_CUES, "secret"), (ACCOUNT_CUES, "account")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                made.add_word(form, (what, len(form)))
    made.make_automaton()
    return made


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by start and then by kind as listed in KINDS."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    done = dict.fromkeys(KINDS, 0)
    tried = {"ip": 0, "card": 0, "phone": 0}  # where the last match of the shape ended, valid or not

    def put(kind: str, span: Span | None) -> None:
        if span and span[0] >= done[kind]:
            out.append((kind, *span))
            done[kind] = span[1]

    def shape(kind: str, pattern: re.Pattern[str], start: int, valid: Callable[[str], bool]) -> None:
        if start < tried[kind]:
            return
        m = pattern.match(text, start)
        if m:
            tried[kind] = m.end()
            if valid(m[0]):
                put(kind, m.span())
        elif kind == "ip":  # no dotted number begins anywhere in these digits
            tried[kind] = NUMBER.match(text, start).end()

    for last, (what, length) in _automaton().iter(text):
        first = last + 1 - length
        if what == "digit":
            shape("card", DIGITS, first, lambda s: 14 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d))
            shape("ip", DOTTED, first, lambda s: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split(".")))
        elif what == "plus":
            shape("phone", PHONE, first, lambda s: 10 <= sum(c.isdigit() for c in s) <= 15)
        elif what == "at":
            put("email", _email(text, first, done["email"]))
        elif what == "scheme":
            put("login", _login(text, first, done["login"]))
        elif what == "secret":
            put("secret", _secret(text, last + 1, done["secret"]))
        elif not (first and text[first - 1].isalnum()):
            put("account", _account(text, last + 1, done["account"]))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def with_spans(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``spans``, the personal data of the whole text."""

    def run(texts: list[str | None]) -> list[list]:
        return [[[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts]]

    return made_columns(documents, [text], f"spans {SPANS}", run, keep)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cover(spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Spans without overlaps: each run of overlapping ones as one, of the kind of its first and longest."""
    runs: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if runs and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
        else:
            runs.append([kind, start, end])
    yield from map(tuple, runs)


def redact(text: str | None) -> str | None:
    """``text`` without personal data; what a replacement brings to light is replaced in turn."""
    while spans := find_spans(text):
        parts, at = [], 0
        for kind, start, end in cover(spans):
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
        text = "".join([*parts, text[at:]])
    return text


def redact_documents(documents: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``documents`` with personal data replaced in ``text``; ``n_chars``, if there is one, counts anew."""
    columns = documents.columns
    made = made_columns(documents, [text], f"`{text}` string", lambda texts: [[redact(t) for t in texts]])
    if n_chars in columns:
        kind = documents.schema[n_chars].dataType
        made = made.withColumn(n_chars, F.length(text).cast(kind))
    return made.select(*columns)
