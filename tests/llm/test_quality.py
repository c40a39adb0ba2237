from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")


def slow_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(covered)


def test_repeats_equal_brute_force():
    rng = random.Random(1)
    for n in [0, 1, 7, 8, 9, 16, 17, 40, 200]:
        for alphabet in (1, 2, 3, 50):
            words = [f"w{rng.randrange(alphabet)}" for _ in range(n)]
            words += words[: n // 2]
            assert quality.repeat_words(words) == slow_repeats(words)


@pytest.mark.parametrize(
    ("text", "counts"),
    [(None, (0, 0, 0, 0, 0, 0)), ("", (0, 0, 0, 0, 0, 0)), (" \n#", (1, 1, 1, 1, 0, 0)), ("a\na\n\n\nb é|\na", (5, 6, 1, 4, 2, 0)), ("a\x1cb \x0bc", (2, 4, 0, 1, 0, 0))],
)
def test_counts(text, counts):
    assert quality.text_counts(text) == counts


def test_buckets_are_narrow_and_ascending(spark):
    values = [*range(300), *(x for e in range(8, 62) for x in ((1 << e) - 1, 1 << e, (1 << e) + 1))]
    frame = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket(F.col("v")))
    rows = frame.withColumn("low", quality.bucket_floor(F.col("b"))).orderBy("v").collect()
    assert all(r["low"] <= r["v"] <= r["low"] + max(0, r["low"] // 32) for r in rows)
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_sketches_merge(spark, documents):
    rng = random.Random(4)
    rows = [(i, " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 40))), rng.choice(["en", None]), rng.choice("ab")) for i in range(400)]
    counted = quality.with_counts(documents(*rows))
    whole = quality.quartiles(quality.sketches(counted, ["lang", "source"]), ["lang"]).collect()
    exact = quality.quartiles(quality.sketches(counted, ["lang"]), ["lang"]).collect()
    assert sorted(map(str, whole)) == sorted(map(str, exact))
    lengths = {}
    for _, text, lang, _ in rows:
        w = text.split()
        lengths.setdefault(lang, []).append(100 * sum(map(len, w)) // len(w))
    for r in exact:
        if r["measure"] == "word_length":
            ordered = sorted(lengths[r["lang"]])
            for share, q in ((1, r["q1"]), (3, r["q3"])):
                true = ordered[-(-share * len(ordered) // 4) - 1]
                assert q <= true <= q * 33 / 32 + 1


def test_fences_follow_their_source(documents):
    rng = random.Random(9)
    text = lambda junk: " ".join(rng.choice(["word", "other", "texts"]) + str(rng.randrange(10**6)) + ("###" if junk and rng.random() < 0.5 else "") for _ in range(60))
    # source a is made of symbols, so they are usual there; in source b they stand out
    rows = [(i, text(True), "en", "a") for i in range(150)] + [(1000 + i, text(i < 5), "en", "b") for i in range(150)]
    judged = {r["doc_id"]: r["kept"] for r in quality.judge_quality(documents(*rows)).collect()}
    assert all(judged[i] for i in range(150)) and not any(judged[1000 + i] for i in range(5)) and all(judged[1005 + i] for i in range(145))


def test_repeats_are_judged_by_the_tail_of_their_group(documents):
    rng = random.Random(11)

    def text(repeated, lines):
        words = [f"w{rng.randrange(10**7)}" for _ in range(100)]
        words[50 : 50 + repeated] = words[:repeated]
        return "\n".join([" ".join(words), *(f"line {i // 2 if lines else rng.random()}" for i in range(10))])

    # most texts of source a repeat a passage of ten words, in source b two of 150 do; both rules count a line twice in one text
    rows = [(i, text(10, i == 3), "en", "a") for i in range(150)] + [(1000 + i, text(10 if i < 2 else 0, i == 3), "en", "b") for i in range(250)]
    judged = {r["doc_id"]: r for r in quality.judge_quality(documents(*rows)).collect()}
    assert not any(r["base_failed"] for r in judged.values())
    assert sorted(i for i, r in judged.items() if not r["kept"]) == [3, 1000, 1001, 1003]


def test_odd_rows(odd, none):
    judged = quality.judge_quality(odd).collect()
    assert len(judged) == 10
    by_id = {r["doc_id"]: r for r in judged}
    assert all(by_id[i]["base_failed"] and not by_id[i]["kept"] for i in (1, 2, 3, 4, 5, 6))
    assert by_id[4]["n_words"] == 20_000 and by_id[4]["n_repeat_words"] == 20_000
    assert quality.judge_quality(none).collect() == [] and quality.filter_quality(none).collect() == []
    assert quality.filter_quality(odd).columns == odd.columns


def test_filter_keeps_what_is_judged_kept(documents):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(rng.randint(5, 60))), "en", "a") for i in range(60)]
    frame = documents(*rows, (7, rows[7][1], "en", "a"), clashing=True)
    kept = sorted(r["doc_id"] for r in quality.judge_quality(frame).where("kept").collect())
    assert sorted(r["doc_id"] for r in quality.filter_quality(frame).collect()) == kept and len(kept) > 30
