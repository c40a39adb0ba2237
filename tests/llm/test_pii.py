from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow_base(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and slow_luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE]


TEXTS = [
    None, "", "a@b.c", "a@b.c@d.e", "@b.c", "a@b", "a@b..c", "x.y+z%_-@a-b.c.d.", "é.a@b.cé", "..@-.-", "a@b.c-d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255",
    "1.2.3 1..2.3.4", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "4111 1111 1111 1112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "79927398713" * 2,
    "+1 (017) 555-7713 x", "++1 555 555 5555", "+1 555", "+12345678901234567", "+1-555-555-5555.", "+1 (555) 555-5555 +1 (555) 555-5556", "192.168.0.1@x.y", "4111111111111111.2.3.4", "+4111111111111111",
    "😀 a@b.c", "1" * 300 + ".2.3.4", "0.0.0.0", "0000256.1.1.1",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_the_patterns(text):
    assert base(text) == slow_base(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@+-0125 ()é\n4", max_size=60))
def test_base_equals_the_patterns_on_any_text(text):
    assert base(text) == slow_base(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ('token = "f3ef4d6b2755a36d"', "secret", "f3ef4d6b2755a36d"), ("API_KEY: abcd1234efgh", "secret", "abcd1234efgh"), ("the token = nothing here", "secret", None), ("tokens are 12345678", "secret", None),
        ("ftp://joe:pa55@host/x", "login", "joe:pa55"), ("http://host/a:b@c", "login", None), ("http://example.com/", "login", None), ("IBAN GB82 WEST 1234 5698 7654 32 ok", "account", None),
        ("IBAN: GB82WEST12345698765432.", "account", "GB82WEST12345698765432"), ("IBAN GB83WEST12345698765432", "account", None), ("account number 1234-5678", "account", "1234-5678"), ("SSN 078-05-1120", "account", "078-05-1120"),
        ("account of 12 people", "account", None), ("au Liban 1234567", "account", None),
    ],
)
def test_added_kinds(text, kind, found):
    got = [text[a:b] for k, a, b in pii.find_spans(text) if k == kind]
    assert got == ([found] if found else [])


def test_redact():
    text = 'Mail a@b.com, 4111111111111111 or +1 (555) 555-5555; token = "abcd1234" end'
    assert pii.redact(text) == 'Mail [EMAIL], [CARD] or [PHONE]; token = "[SECRET]" end'
    assert pii.redact("x 192.168.0.1@a.b y") == "x [EMAIL] y"
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("clean text, as it was") == "clean text, as it was"
    assert not base(pii.redact(" ".join(t for t in TEXTS if t)))


def test_long_texts_take_linear_time():
    for bad in ("1", "1.", "a@", "+1", "1 ", "a.", "@", "://a:", "token=", "iban A1"):
        pii.find_spans(bad * 30_000)


def test_frame(spark, odd, none):
    rows = pii.with_spans(odd).select("doc_id", "spans").collect()
    assert len(rows) == 10 and all(r["spans"] == [] for r in rows)
    clean = pii.redact_documents(odd)
    assert clean.columns == odd.columns and clean.dtypes == odd.dtypes
    assert sorted(map(str, (tuple(r) for r in clean.select("doc_id", "text").collect()))) == sorted(map(str, (tuple(r) for r in odd.select("doc_id", "text").collect())))
    assert pii.redact_documents(none).collect() == []


def test_listed_spans(documents):
    frame = pii.with_spans(documents((1, "é a@b.c 1.2.3.4")))
    assert frame.select(pii.listed(frame.spans)).first()[0] == "email:2:7,ip:8:15"
    assert pii.redact_documents(documents((1, "a@b.c"))).first()["n_chars"] == len("[EMAIL]")
