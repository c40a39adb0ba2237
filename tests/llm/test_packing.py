from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import packing


def slow_best_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [
            (room - length, i) for i, (room, sources, clusters) in enumerate(bins)
            if room >= length and (source is None or source not in sources) and (cluster is None or cluster not in clusters)
        ]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, set(), set()))
        room, sources, clusters = bins[i]
        out.append((i, capacity - room))
        bins[i] = (room - length, sources | {source}, clusters | {cluster})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    made = [(rng.randint(0, 100), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(40)])) for _ in range(300)]
    made.sort(key=lambda p: -p[0])
    assert packing.best_fit(made, 100) == slow_best_fit(made, 100)


def check(rows, found, capacity):
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    bins = defaultdict(list)
    for r in found:
        bins[r["bin"]].append(r)
        assert len(r["text"]) == r["length"] <= capacity
        assert any(t[r["start"] : r["start"] + r["length"]] == r["text"] for t in texts[r["doc_id"]])
    assert sum(r["length"] for r in found) == sum(len(t) for x in texts.values() for t in x)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        sources = [r["source"] for r in own if r["source"] is not None]
        assert len(sources) == len(set(sources))
        whole = [r["text"] for r in own if r["piece"] == 0 and r["length"]]
        assert len(whole) == len(set(whole))
    return bins


@pytest.mark.parametrize("shard", [7, 4096])
def test_rows_are_whole_and_bins_valid(documents, shard):
    rng = random.Random(shard)
    rows = [(i, "é" * rng.randint(0, 250), "en", rng.choice(["hot", "hot", "a", "b", "c", None])) for i in range(200)]
    rows += [(1, None, None, None), (None, "text", None, None), (300, "y" * 1000, "en", "a"), (300, "y" * 1000, "en", "a")]
    found = packing.pack(documents(*rows, clashing=True), capacity=100, shard=shard, with_text=True).collect()
    check(rows, found, 100)
    again = packing.pack(documents(*rows), capacity=100, shard=shard, with_text=True).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_packs_tightly(documents):
    rows = [(i, "x" * (60 if i % 2 else 40), "en", None) for i in range(400)]
    frame = documents(*rows)
    bins = {r["bin"] for r in packing.pack(frame, 100, cluster=F.lit(None)).collect()}
    assert len(bins) == 200


def test_repeated_rows_fill_chunks(documents, monkeypatch):
    rows = [(1, "same text", "en", None)] * 50
    found = packing.pack(documents(*rows), 100, shard=4, with_text=True).collect()
    assert len(found) == 50 and len({r["bin"] for r in found}) == 50  # copies never share a bin


def test_odd_rows(odd, none):
    found = packing.pack(odd, with_text=True).collect()
    check([tuple(r)[:2] for r in odd.select("doc_id", "text").collect()], found, packing.CAPACITY)
    assert len(found) == 9 + -(-4000 * 31 // packing.CAPACITY)
    assert packing.pack(none).collect() == []
    assert packing.pack(none).columns == ["bin", "offset", "doc_id", "piece", "start", "length", "source"]


def test_null_texts_conflict_with_nothing(documents):
    made = packing.pack(documents((1, None, "en", None), (2, None, "en", None), (3, None, "en", None), (4, "", "en", None), (5, "", "en", None))).collect()
    bins = {r["doc_id"]: r["bin"] for r in made}
    assert len({bins[i] for i in (1, 2, 3)}) == 1 and bins[4] != bins[5]
