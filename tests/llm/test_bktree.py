from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from glyphloom.llm import bktree


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def slow_components(prints, radius=4):
    """Label (smallest signed fingerprint reachable) of each fingerprint."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ÀB c D e", "a b c d", "a a a a a a", "x\x0by\x1cz q r s T", "w " * 70_000])
def test_fingerprint(text):
    assert bktree.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def clusters(rng, groups, size, bits):
    out = []
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(1, bits)):
                x ^= 1 << b
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("part", [3, 100])
def test_links_connect_what_is_near(spark, part, monkeypatch, tmp_path):
    monkeypatch.setattr(bktree, "PROBES", 5)
    prints = sorted(set(clusters(random.Random(6), 30, 9, 6) + [0, 1, 2, 3, 15, 31, -1, -2]))
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long").repartition(2)
    found = bktree.links(frame, str(tmp_path), 4, part)
    labels = dict(tuple(r) for r in bktree.components(found, str(tmp_path / "c")).collect())
    want = slow_components(prints)
    assert {p: labels.get(p, p) for p in prints} == want


def test_trees_follow_only_near_edges():
    rng = random.Random(1)
    points = np.array(sorted({rng.getrandbits(64) for _ in range(500)} | {(1 << i) - 1 for i in range(40)}), np.uint64)
    group = np.repeat([0, 1], [200, len(points) - 200])
    trees = bktree.build_trees(points, group)
    start, count, edge, order = trees
    for parent in range(len(points)):
        children = order[start[parent] : start[parent] + count[parent]]
        distances = [int(points[parent] ^ points[c]).bit_count() for c in children]
        assert distances == sorted(set(distances)) == edge[children].tolist()
    roots = np.repeat([0, 200], [200, len(points) - 200])
    got = {(int(a), int(b)) for p, n in bktree.search_trees(points, trees, points, roots, 4) for a, b in zip(p, n, strict=True)}
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if group[i] == group[j] and int(points[i] ^ points[j]).bit_count() <= 4}
    assert got == want


def test_chain_is_one_component(spark, tmp_path):
    rows = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    found = bktree.components(spark.createDataFrame(rows, "a long, b long"), str(tmp_path / "c"))
    labels = dict(tuple(r) for r in found.collect())
    assert labels == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert bktree.components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "d")).collect() == []


def words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(2)
    rows = []
    for group in range(8):
        base = words(rng, 150)
        for copy in range(6):
            rows.append((len(rows), " ".join(base)))
            if copy % 2:
                base[rng.randrange(150)] = f"new{group}"
    rows += [(900, None), (901, ""), (902, " "), (None, "one two three"), (903, "one two three"), (904, "one two three"), (904, "one two three")]
    got = bktree.near_duplicates(documents(*rows, clashing=True)).collect()
    prints = [(i, bktree.fingerprint(t)) for i, t in rows]
    label = slow_components([f for _, f in prints])
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[label[f]] = min(i, smallest.get(label[f], i))
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(map(str, ((i, f, smallest[label[f]]) for i, f in prints)))
    assert len(set(smallest.values())) < len({f for _, f in prints})


def test_one_of_each_group_stays(odd, none, documents):
    kept = bktree.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # 1, 2 and 3 have no words; 5 (twice) and 7 are copies; the row of nulls has no words either
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "None"]
    assert bktree.drop_near_duplicates(none).collect() == [] and bktree.near_duplicates(none).collect() == []
    alone = documents((None, "a b c"), (None, "a b c"), (None, "other words here"))
    assert sorted(r["text"] for r in bktree.drop_near_duplicates(alone).collect()) == ["a b c", "other words here"]
    plain = documents((1, "a b c d e f"), (2, "a b c d e f"), (3, "quite another text than that"))
    assert sorted(r["doc_id"] for r in bktree.drop_near_duplicates(plain).collect()) == [1, 3]


def test_every_near_pair_shares_a_shard():
    rng = random.Random(5)
    pairs = []
    for _ in range(2000):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), 4))))
    keys = bktree.shard_keys(np.array(pairs, np.uint64).ravel()).reshape(len(pairs), 2, -1)
    assert keys.shape[2] == 15 and (keys[:, 0] == keys[:, 1]).any(1).all()


def test_dropping_keeps_one_of_each_component(documents):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = words(rng, rng.choice([60, 200, 400]))
        for _ in range(4):
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = f"new{rng.randint(0, 10**6)}"
    rng.shuffle(texts)
    texts += [texts[3], None, "", "one two", "One  two", "one two three"]
    prints = [bktree.fingerprint(t) for t in texts]
    label = slow_components(prints)
    first = {}
    for i, f in enumerate(prints):
        first.setdefault(label[f], i)
    kept = {r["doc_id"] for r in bktree.drop_near_duplicates(documents(*enumerate(texts), clashing=True)).collect()}
    assert kept == set(first.values()) and len(kept) < len(texts) - 20
