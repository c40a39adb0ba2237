from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import langid

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(langid.training_sample(documents))
    rows = langid.with_language(documents, model).select("doc_id", "lang", "text", "lang_pred", "score", langid.held_out(F.col("doc_id")).alias("out")).collect()
    return model, rows


def test_held_out_accuracy(judged):
    _, rows = judged
    out = [r for r in rows if r["out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(out) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_trains_on_all_that_is_not_held_out(spark, judged):
    model, rows = judged
    words = {w for r in rows if not r["out"] for w in langid.tokens(r["text"])}
    assert set(model.words) <= words
    sample = langid.training_sample(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert set(langid.fit(sample, 10**7).words) == words


def test_entries_are_bounded_for_each_language(documents):
    frame = documents((1, "aa aa aa bb bb cc dd", "x"), (3, "aa bb ee ee", "y")).select("lang", "text")
    of = lambda most: set(langid.fit(frame, most).words)
    assert of(2) == {"aa", "ee"} and of(4) == {"aa", "bb", "ee"} and of(1) == set()
    assert of(8) == {"aa", "bb", "cc", "dd", "ee"}


def test_rare_languages_keep_their_words(documents):
    full = [(i, " ".join(f"common{j}" for j in range(50)), "x") for i in range(1, 60)]
    frame = documents(*full, (100, "seldom rare", "y")).select("lang", "text")
    assert {"seldom", "rare"} <= set(langid.fit(frame, 40).words)


@pytest.mark.parametrize("text", ["² ½", "Ⅳ", "123 _ ٣", "①"])
def test_numerals_are_no_letters(documents, text):
    model = langid.fit(documents((1, "same text", "b"), (3, "other words", "a")).select("lang", "text"))
    assert langid.predict(model, text, {}) == ("und", 0.0)
    assert langid.tokens(f"x{text}y") == ["x", "y"]


def test_unseen_words_back_off(judged):
    model, _ = judged
    word = next(w for w in model.words if len(w) > 4) + "qqq"
    assert word not in model.words
    names = {i: g for g, i in model.grams.items()}
    known = [names[r] for r in langid.backoff(model, word)]
    assert known and all(len(g) == len(known[0]) and g in f"<{word}>" for g in known)
    longer = langid.grams(word, len(known[0]) + 1)
    assert len(known[0]) == langid.LONGEST or not any(g in model.grams for g in longer)
    assert langid.backoff(model, "字") == []
    assert langid.predict(model, "字", {})[0] in model.langs


def test_odd_rows(spark, odd, none):
    model = langid.fit(langid.training_sample(odd))
    assert model.langs == ["en", "es"] or set(model.langs) <= {"en", "es"}
    rows = langid.with_language(odd, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == 10
    for r in rows:
        assert (r["lang_pred"] == "und" and r["score"] == 0) == (not langid.tokens(r["text"]))
    empty = langid.fit(langid.training_sample(none))
    assert empty.langs == [] and langid.predict(empty, "some words", {}) == ("und", 0.0)
    assert langid.with_language(none, empty).collect() == []


def test_filter_keeps_rows_as_they_are(odd, none):
    kept = langid.filter_language(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "5", "6", "7", "None"]
    assert langid.filter_language(none).collect() == []


def test_sample_is_bounded(documents):
    frame = documents(*((i, f"word{i}", "en" if i % 3 else "de") for i in range(3000)))
    n = langid.training_sample(frame, size=100).count()
    assert 120 < n < 280


def test_ties_go_to_the_first_language(documents):
    model = langid.fit(documents((1, "same text", "b"), (3, "same text", "a")).select("lang", "text"))
    assert langid.predict(model, "same text", {}) == ("a", 0.5)

