from __future__ import annotations

import random

import pytest

from glyphloom.llm import urlrules
from glyphloom.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, verdict string, rule string"


def slow_parts(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def slow_judge(url, rules):
    host, path = slow_parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[3:] if fits else (None, "allow")
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "https://A.ORG", "https://a.org/", "http://org/x", "https://www.Example.org/es/1", "https://example.org/es", "http://myexample.org/es/", "http://example.org/en/12?x=/y#z",
    "http://a.com/fr/", "http://com/de/#x", "x://y://example.org/es/", "http://example.org:80/es/", "http://example.org?q=/es/", "http://example.org#/es/", "http://.org/", "http://a..org/x", "http://É.org/é", "http://example.com.org/fr/", "://org/",
]


def judged(spark, urls, rules):
    frame = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], SCHEMA)
    rows = urlrules.judge_urls(frame, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    return {r["page_id"]: tuple(r)[1:] for r in rows}


def test_contract(spark):
    got = judged(spark, URLS, URL_RULES)
    assert got == {i: slow_judge(u, URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("block", [25, 10**6])
def test_nested_rules_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(urlrules, "BLOCK", block)
    rng = random.Random(block)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "a-b"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randint(0, 3)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http://{host()}{path()}" for _ in range(400)]
    want = {i: slow_judge(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == want
    table = spark.createDataFrame([*rules, (None, "/", "allow"), ("a", None, "block")], "host string, path string, verdict string")
    assert judged(spark, urls, table) == want


def test_odd_rows(spark):
    assert judged(spark, ["http://a.org/"], []) == {0: ("a.org", "/", None, "allow")}
    assert judged(spark, ["http://A.org/"], [("A.ORG", "/", "block")]) == {0: ("a.org", "/", "a.org/", "block")}
    frame = spark.createDataFrame([(None, "http://a.org/x" * 9000), (None, "http://a.org/"), (None, "http://a.org/")], "page_id long, url string")
    assert urlrules.judge_urls(frame, URL_RULES).count() == 3
    assert urlrules.judge_urls(frame.limit(0), URL_RULES).collect() == []
    assert urlrules.judge_urls(frame.limit(0), URL_RULES).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
