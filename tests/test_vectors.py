from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import vectors
from glyphloom.operators import embed, search
from glyphloom.operators.extract import extract_snippets

ROWS = "id string, embedding array<float>"
ASKED = "query_id long, embedding array<float>"


def hits(df):
    rows = df.orderBy("query_id", "rank").collect()
    return [(r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in rows]


def best(known, asked, k):
    """Top-k by sorting all pairs."""

    def unit(v):
        v = np.float32(v).astype(float)
        n = np.linalg.norm(v)
        return v / n if n else v

    found = []
    for q, w in asked:
        scored = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, v in known)
        found += [(q, n, i, -s + 0.0) for n, (s, i) in enumerate(scored[: max(k, 0)], 1)]
    return found


def test_normalize_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.l2_normalize(F.col("a")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [([0.6, 0.8], 0.96), ([0.0, 0.0], 0.0)]


def test_top_k_edges(spark):
    known = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-3.0, 0.0]), ("d", [5.0, 5.0])]
    df, one = spark.createDataFrame(known, ROWS), spark.createDataFrame([(7, [9.0, 0.0])], ASKED)
    assert hits(search.top_k(df, one, 2)) == [(7, 1, "a", 1.0), (7, 2, "d", 0.707107)]
    assert [h[2] for h in hits(search.top_k(df, one, 50))] == ["a", "d", "b", "c"]
    assert hits(search.top_k(df, one, 50))[-1][3] == -1.0
    assert hits(search.top_k(df, one, 0)) == hits(search.top_k(df, one, -1)) == []
    assert hits(search.top_k(df.where("false"), one, 3)) == []
    assert hits(search.top_k(df, one.where("false"), 3)) == []
    zero = spark.createDataFrame([(1, [0.0, 0.0])], ASKED)
    assert hits(search.top_k(df, zero, 2)) == [(1, 1, "a", 0.0), (1, 2, "b", 0.0)]


@pytest.mark.parametrize("route", ["broadcast", "cells"])
def test_both_routes_equal_all_pairs(spark, route):
    """Many equal vectors, a third of them copies of one: ties go to the smaller id."""
    rng = np.random.default_rng(3)
    known = [(f"v{i:04d}", rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(400)]
    known += [(f"copy{i:04d}", [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]) for i in range(200)]
    asked = [(q, rng.integers(-1, 2, 6).astype(float).tolist()) for q in range(30)]
    random.Random(1).shuffle(known)
    df = spark.createDataFrame(known, ROWS).repartition(5)
    queries = spark.createDataFrame(asked, ASKED)
    limits = {} if route == "broadcast" else {"broadcast_bytes": 0, "cell_bytes": 1000}
    for k in (1, 7, 300):
        assert hits(search.top_k(df, queries, k, **limits)) == best(known, asked, k)


def test_scores_are_computed_in_bounded_slices(spark, monkeypatch):
    ids, rows = search.pa.array([f"v{i}" for i in range(50)]), np.random.default_rng(0).normal(size=(50, 4))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    keys = search.pa.array(range(20))
    whole = [b.to_pylist() for b in search._best(keys, rows[:20], ids, rows, 3)]
    monkeypatch.setattr(search, "_MAX_SCORES", 150)
    sliced = [b.to_pylist() for b in search._best(keys, rows[:20], ids, rows, 3)]
    assert len(whole) == 1 and len(sliced) == 7
    key = lambda r: (r["query_id"], r["id"])
    flat = lambda parts: sorted((r for p in parts for r in p), key=key)
    assert [key(r) for r in flat(whole)] == [key(r) for r in flat(sliced)]


def test_number_keys(spark):
    df = spark.createDataFrame([(10, [1.0]), (9, [1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    assert hits(search.top_k(df, asked, 5)) == [("q", 1, 9, 1.0), ("q", 2, 10, 1.0)]


def test_no_pairs_in_the_plan(spark):
    df, one = spark.createDataFrame([("a", [1.0])], ROWS), spark.createDataFrame([(7, [9.0])], ASKED)
    for limits in ({}, {"broadcast_bytes": 0}):
        plan = search.top_k(df, one, 3, **limits)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_dimensions(spark):
    good = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 3.0])], ROWS)
    assert [tuple(r) for r in search.check_dimension(good).collect()] == [(2, 2)]
    assert [tuple(r) for r in search.check_dimension(good.where("false")).collect()] == [(0, 0)]
    one = spark.createDataFrame([(1, [1.0, 2.0])], ASKED)
    for bad in ([("a", [1.0]), ("b", [1.0, 2.0])], [("a", [1.0, 2.0]), ("b", None)]):
        df = spark.createDataFrame(bad, ROWS).coalesce(1)
        with pytest.raises(Exception, match="one width"):
            search.check_dimension(df).collect()
        with pytest.raises(Exception, match="null|width"):
            search.top_k(df, one, 3).collect()


def test_keyword_embedder(spark):
    model = embed.KeywordEmbedder(["sort", "query", "math"])
    df = spark.createDataFrame([("SORTED queryset",), ("nothing",), ("",)], "t string")
    got = [r["embedding"] for r in embed.embed(df, "t", model).collect()]
    assert [[round(x, 3) for x in v] for v in got] == [[1, 1, 0], [0, 0, 0.01], [0, 0, 0.01]]
    assert embed.embed(df, "t", model).schema["embedding"].dataType.simpleString() == "array<float>"
    assert embed.embedder_named(model.name).vocabulary == model.vocabulary
    with pytest.raises(ValueError):
        embed.KeywordEmbedder([])


def test_model_embedder_runs_in_batches_and_loads_once_per_worker(spark):
    def load():
        sizes = []

        def encode(texts):
            sizes.append(len(texts))
            return np.array([[len(t), max(sizes), id(sizes) % 1] for t in texts])

        return encode

    model = embed.ModelEmbedder("lengths", load)
    df = spark.range(100).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).coalesce(1)
    got = [r["embedding"] for r in embed.embed(df, "t", model, batch_size=8).collect()]
    assert [v[0] for v in got] == list(range(100)) and max(v[1] for v in got) <= 8
    assert embed.embed(df.where("false"), "t", model).collect() == []


def test_registered_models():
    model = embed.register_embedder(embed.ModelEmbedder("own", lambda: None))
    assert embed.embedder_named("own") is model
    assert isinstance(embed.embedder_named("all-MiniLM-L6-v2"), embed.ModelEmbedder)


def test_embed_snippets_sees_language_and_name(texts):
    files = texts(("a.py", "python", "def sorter():\n    pass\n"), ("b.go", "go", "x"))
    rows = embed.embed_snippets(extract_snippets(files), embed.KeywordEmbedder(["sort", "python", "go"]))
    got = {r["file_path"]: r["embedding"] for r in rows.collect()}
    assert got == {"a.py": [1.0, 1.0, 0.0], "b.go": [0.0, 0.0, 1.0]}
