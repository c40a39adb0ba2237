from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    whole = {}
    usable = []
    for i, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [max(-vafile.LIMIT, min(vafile.LIMIT, math.floor(256.0 * float(np.float32(x))))) for x in v]))
    for i, v in usable:
        if i % every == 0:
            whole[i] = min(whole.get(i, v), v)
    out = []
    for q, v in whole.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, every=10, k=5, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3, "vec_id")
    return sorted(tuple(r) for r in vafile.top_k(frame, F.col("vec_id") % every == 0, k, **more).collect())


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], 0) for i in range(300)]
    assert found(spark, rows, bits=bits) == brute(rows, 10, 5)


def test_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)], i) for i in range(120)]  # many ties
    rows += [(200, None, 1), (201, [0.1, None, 0.2], 1), (202, [math.nan, 0.0, 0.0], 1), (203, [math.inf, 0.0, 0.0], 1), (204, [], 1)]
    rows += [(210, [0.5, 0.5], None), (211, [0.25, 0.5], None), (220, [1.0], 1)]  # other lengths: few or no candidates
    rows += [(30, [0.5, 0.5, 0.5], 1), (31, [0.5, 0.5, 0.5], 1), (31, [0.5, 0.5, 0.5], 1), (32, [1e30, -1e30, 3e7], 1)]
    assert found(spark, rows) == brute(rows, 10, 5)


def test_blocks_of_queries_and_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(200)]
    monkeypatch.setattr(vafile, "QUERY_CELLS", 16)
    monkeypatch.setattr(vafile, "PAIRS", 50)
    monkeypatch.setattr(vafile, "SAMPLE", 7)
    assert found(spark, rows, every=20) == brute(rows, 20, 5)


def test_a_third_of_all_rows_alike(spark):
    rng = random.Random(5)
    rows = [(i, [0.25, 0.5, 0.1] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(300)]
    assert found(spark, rows) == brute(rows, 10, 5)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_reads_few_exact_vectors():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(4000, 16)) / 4).astype(np.int64)
    low = v.min(0)
    width = ((v.max(0) - low) >> 8) + 1
    search = vafile.Search(np.array([0]), v[:1], np.array([vafile.LOWEST]), (low, width), 5)
    read = []
    search.add(np.arange(4000), (v - low) // width, lambda rows: read.extend(rows) or v[rows])
    assert len(read) < 100


def test_rows_without_id_take_no_part(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(60)]
    nameless = [(None, [9.0, 9.0, 9.0], 1), (None, [-9.0, 9.0, 0.5], None), (None, None, 1)]
    assert found(spark, rows + nameless) == brute(rows, 10, 5)
    assert found(spark, nameless) == []
