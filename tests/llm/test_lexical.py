from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from glyphloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def slow_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_rank(documents, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(d, Counter(t)) for d, text in documents if (t := slow_terms(text))]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in slow_terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("text", [None, "", " .,;", "Ab-cD é_É ÀB1 x²", "a\x00b\x7fc[d]{e}@f`g:h/i", "İstanbul ß ſ K", "naïve space", "x" * 100_000])
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text)] == slow_terms(text)


def corpus(seed, n, vocabulary=400, words=80):
    rng = random.Random(seed)
    terms = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(terms, weights, k=rng.randint(0, words)))) for i in range(n)]


def search(spark, documents, items, k, **options):
    shown = spark.createDataFrame(documents, "doc_id long, text string, rank string, score string, q int, print int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string, doc_id string, rank string, block int")
    made = lexical.rank(shown, asked, k, **options)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize("seed,k,options", [(1, 3, {}), (2, 10, {"item_chars": 300}), (3, 1, {})])
def test_equals_brute_force(spark, seed, k, options):
    rng = random.Random(seed)
    documents = corpus(seed, 250)
    long = " ".join(f"w{rng.randint(0, 399)} é{i}" for i in range(3000))
    documents += [(None, documents[3][1]), (None, None), (7, documents[7][1]), (7, documents[7][1]), (900, ""), (901, long), (902, documents[5][1]), (903, documents[5][1])]
    items = [(i, documents[rng.randrange(250)][1][:60] + " W1 unseen") for i in range(20 if k > 1 else lexical.ITEMS_AT_ONCE + 5)]
    items += [(30, None), (31, ""), (None, "w3 w9 w200"), (32, "w3 w3 w3 w77"), (32, "w3 w3 w3 w77"), (33, "nothing there")]
    got = search(spark, [(*d, None, None, None, None) for d in documents], [(*i, None, None, None) for i in items], k, **options)
    assert got == slow_rank(documents, items, k)


def test_hot_text_and_empty_tables(spark):
    documents = [(i, "same words in every copy") for i in range(200)] + [(500 + i, f"other words {i}") for i in range(20)]
    items = [(1, "same words"), (2, "other 7")]
    assert search(spark, [(*d, None, None, None, None) for d in documents], [(*i, None, None, None) for i in items], 5) == slow_rank(documents, items, 5)
    assert search(spark, [], [(1, "x", None, None, None)], 5) == [] and search(spark, [(1, "x", None, None, None, None)], [], 5) == []


def test_bounds_hold_and_exclude():
    documents = [t for _, t in corpus(9, 600, vocabulary=3000, words=200) if t]
    items = lexical.Items.of([" ".join(t.split()[:12]) for t in documents[:40]])
    held = [Counter(lexical.terms(t)) for t in documents]
    sizes, most = np.array([sum(c.values()) for c in held]), np.array([max(c.values()) for c in held])
    weights = [math.floor(1000 * math.log((2 * len(held) + 2) / (2 * sum(t in c for c in held) + 1))) for t in items.vocabulary]
    own = lexical.Scoring(len(held), int(sizes.sum()), np.array(weights))
    from xxhash import xxh64_intdigest as digest

    rows = [(i, 0, 0, np.array([digest(t) for t in c], np.uint64), np.array(list(c.values()))) for i, c in enumerate(held)]
    picked = [lexical.places(items.hashes(), level, 4096) for level in range(len(lexical.LEVELS))]
    bounds = lexical._bounds(lexical._sliced(rows, 4096), sizes, most, picked, items, own, 0)
    counts = np.array([[c[t] for t in items.vocabulary] for c in held])
    factors = lexical.factor(counts, own.norms(sizes)[:, None])
    exact = np.array([[(own.weights[at] * often * f[at]).sum() for f in factors] for at, often in items.own])
    assert (bounds >= exact).all() and (bounds <= 1.6 * exact + 5e9).mean() > 0.95
    tenth = np.sort(exact, 1)[:, -10]
    assert (bounds >= tenth[:, None]).mean() < 0.1


def test_norms_beyond_64_bits():
    own = lexical.Scoring(10**12, 10**15, np.zeros(0, np.int64))
    assert own.norms(np.array([10**9, 1])).tolist() == [25 + 75 * 10**9 * 10**12 // 10**15, 25]
