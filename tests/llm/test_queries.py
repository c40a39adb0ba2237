from __future__ import annotations

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare
from glyphloom.llm import bktree, pii, quality, secretscan
from glyphloom.llm.queries import ORACLES, QUERIES

from .test_bktree import slow_components
from .test_pii import slow_base
from .test_secretscan import slow_base as slow_secrets
from .test_vafile import brute

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # the smallest tables with secrets


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, FOLDER, name).startswith("ok")


def rows(name, folder=FOLDER):
    return duckdb.sql(f"SELECT * FROM '{folder}/{name}.parquet'").fetchall()


def test_op1(spark):
    got = sorted(tuple(r) for r in QUERIES["op1_vector_approximation"](spark, FOLDER).collect())
    assert got == brute(rows("embeddings"), 50, 5)


def test_op4(spark):
    documents = rows("documents")
    prints = {d[0]: bktree.fingerprint(d[1]) for d in documents}
    label = slow_components(prints.values())
    smallest = {}
    for i, f in prints.items():
        smallest[label[f]] = min(i, smallest.get(label[f], i))
    got = {tuple(r) for r in QUERIES["op4_simhash"](spark, FOLDER).collect()}
    assert got == {(i, f"{f % (1 << 64):016x}", smallest[label[f]]) for i, f in prints.items()}


def test_op11(spark):
    texts = {d[0]: d[1] for d in rows("documents", LARGER)}
    found = QUERIES["op11_secrets"](spark, LARGER).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    assert any(r["n_assign"] for r in found) and any(r["n_hex"] for r in found)
    for r in found:
        want = slow_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secretscan.BASE] == [sum(s[0] == k for s in want) for k in secretscan.BASE]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in secretscan.BASE] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_op7(spark):
    texts = {d[0]: d[1] for d in rows("documents")}
    for r in QUERIES["op7_personal_data"](spark, FOLDER).collect():
        want = slow_base(texts[r["doc_id"]])
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k in pii.BASE] == want
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]


@pytest.mark.parametrize("name", ["op2_main_text", "op3_language", "op6_byte_bpe", "op9_best_fit", "op10_warc_derivatives"])
def test_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name in ("op2_main_text", "op10_warc_derivatives") else ("documents", "doc_id")
    got = QUERIES[name](spark, FOLDER).collect()
    assert {r[key] for r in got} == {r[0] for r in rows(table)}


def test_pipeline_equals_its_steps_by_hand(spark):
    from glyphloom.llm import langid

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(langid.training_sample(documents))
    told = [d for d in documents.collect() if langid.predict(model, d["text"], {})[1] >= 0.4]
    frame = spark.createDataFrame(told, documents.schema)
    passed = {r["doc_id"] for r in quality.judge_quality(frame).where("kept").collect()}
    left = {d["doc_id"]: d["text"] for d in told if d["doc_id"] in passed}
    label = slow_components([bktree.fingerprint(t) for t in left.values()])
    first = {}
    for i in sorted(left):
        first.setdefault(label[bktree.fingerprint(left[i])], i)
    kept = {i: pii.redact(left[i]) for i in first.values()}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    texts = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["text"]
    assert texts == kept
    assert 0 < len(kept) < len(rows("documents"))
    assert all(not slow_base(t) for t in texts.values())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, none, stage, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    made = stage(spark, docs, FOLDER)
    made.collect()
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or made.columns == docs.columns
    assert stage(spark, none, FOLDER).collect() == []


