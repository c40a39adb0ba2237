from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import merkle
from glyphloom.llm.queries import QUERIES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(nodes):
    """Top of the nodes, and for each the partners on its way there."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, at in enumerate(where):
            partner = at ^ 1
            paths[i].append(("-", "") if partner >= len(level) else ("L" if partner < at else "R", level[partner]))
            where[i] = at // 2
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def slow_manifest(rows):
    """The query's rows for documents (doc_id, text, lang, source, n_chars)."""
    fields = lambda r, more=0: (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(fields(r))))
        tops[lang] = slow_tree([slow_leaf(fields(r)) for r in trees[lang]])
    root, upper = slow_tree([tops[x][0] for x in langs])
    out = []
    for lang, more in zip(langs, upper, strict=True):
        for r, path in zip(trees[lang], tops[lang][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = slow_leaf(fields(r, int(changed)))
            for side, other in path + more:
                node = h({"L": other + node, "R": node + other, "-": node}[side])
            out.append((r[0], slow_leaf(fields(r)), tops[lang][0], root, h("".join(x for _, x in path + more)), node, node == root))
    return sorted(out, key=str)


def query(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    made = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2}, {"en": 64, "de": 1}, {"en": 65, "de": 63, None: 3, "": 2}, {"en": 300, "é": 7, "z": 128}])
def test_equals_brute_force(spark, documents, tmp_path, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randint(-5, 10**6), f"text é {i}", lang, rng.choice(["s", None]), rng.choice([None, i])) for lang, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    assert query(spark, documents(*rows).repartition(3), tmp_path) == slow_manifest(rows)


def test_many_languages(spark, documents, tmp_path):
    rows = [(i, "t", f"l{i % 150}", "s", i) for i in range(160)]
    assert query(spark, documents(*rows), tmp_path) == slow_manifest(rows)


def test_odd_rows(spark, odd, none, tmp_path):
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert query(spark, odd, tmp_path) == slow_manifest(rows)
    (tmp_path / "none").mkdir()
    assert query(spark, none, tmp_path / "none") == []


def test_repeated_rows_and_tampering(spark, documents, tmp_path):
    rows = [(5, "same", "en", "s", 4)] * 200 + [(i, "other", "en", "s", None if i % 2 else 5) for i in range(60)]
    got = query(spark, documents(*rows), tmp_path)
    assert got == slow_manifest(rows)
    wrong = {r[0] for r in got if not r[6]}
    assert wrong == {i for i in range(60) if not i % 2 and zlib.crc32(str(i).encode()) % 7 == 0}


@pytest.mark.parametrize("every", [1, 2, 6])
def test_checkpoints_are_few_and_paths_lead_to_the_root(spark, tmp_path, every):
    nodes = spark.range(100).select(F.lit("t").alias("tree"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("node"))
    manifest = merkle.write_manifest(nodes, str(tmp_path / "m"), every)
    top, paths = slow_tree([h(str(i)) for i in range(100)])
    assert manifest.root() == top and manifest.last() == -(-7 // every)
    assert sum(manifest.checkpoint(i).count() for i in range(1, manifest.last() + 1)) == sum(-(-100 >> every * i) for i in range(1, manifest.last() + 1))
    got = {r["key"]: r["path"] for r in manifest.paths(["key"]).collect()}
    assert [got[i] for i in range(100)] == [[a + b for a, b in p] for p in paths]
    assert manifest.paths(["key", "node"]).where(merkle.fold(merkle.hex_text(F.col("node")), F.col("path")) != top).count() == 0
