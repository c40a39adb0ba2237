from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from glyphloom.functions import text
from glyphloom.sources.tables import decode_files

ODD = ["a", "b c", "\n", "\n", "\r\n", "\r", " ", "\t", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f",
       "\x85", "\xa0", " ", " ", "　", "é", "𝕏"]


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect())]


def test_decode(spark):
    raws = {
        b"plain": "plain",
        "é€".encode(): "é€",
        b"\xef\xbb\xbfmarked": "marked",
        b"caf\xe9": "café",
        b"\xef\xbb\xbf\xe9": "ï»¿é",
        b"\xed\xa0\x80": "\xed\xa0\x80",
        b"zero\x00byte": None,
        b"": "",
    }
    got = column(spark, [bytearray(b) for b in raws], text.decode_text, "binary")
    assert got == list(raws.values())


def test_decode_files_drops_binary_and_unread(spark):
    rows = [("a", bytearray(b"x")), ("b", bytearray(b"\x00")), ("c", None)]
    files = spark.createDataFrame(rows, "file_path string, content binary")
    assert [tuple(r) for r in decode_files(files).collect()] == [("a", "x")]
    rows = [("a", "x"), ("b", "\x00"), ("c", None)]
    files = spark.createDataFrame(rows, "file_path string, content string")
    assert [tuple(r) for r in decode_files(files).collect()] == [("a", "x")]


def test_lines_equal_python_splitlines(spark):
    random.seed(7)
    samples = ["", "\n", "a", "a\n", "a\n\n", "\r\n\r"]
    samples += ["".join(random.choices(ODD, k=random.randint(1, 12))) for _ in range(1500)]
    assert column(spark, samples, text.split_lines) == [s.splitlines() for s in samples]


def test_plain_newlines_only(spark):
    got = column(spark, ["a\r\nb\rc\x0cd\n", "\n"], lambda c: text.split_lines(c, text.NEWLINES))
    assert got == [["a", "b", "c\x0cd"], [""]]


def test_whole_texts_meet_no_regex_but_for_odd_breaks(spark):
    """A regex over every character took a fifth of a build."""
    for breaks in (text.LINE_BREAKS, text.NEWLINES):
        frame = spark.range(1).select(text.split_lines(F.col("id").cast("string"), breaks).alias("r"))
        assert "rlike" not in frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_has_text(spark):
    values = ["", " ", "   \t ", "   x", "\t y ", "\xa0 ", "  \u3000", "  \x1f ", "é", None]
    assert column(spark, values, text.has_text) == [None if v is None else bool(v.strip()) for v in values]


def test_lines_that_begin_visibly_meet_no_regex(spark):
    """A comparison of bytes comes first, at a fifth less for splitting a text into blocks."""
    values = [a + b for a in ["", " ", "  ", *map(chr, range(33)), "!", "~", "~~", "\x7f", "\x80", "\x85", "\xa0", "\xe9", "𝕏"] for b in ["", " ", "x", "\u2003"]]
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u2003"
    assert column(spark, values, text.has_text) == [bool(v.strip(spaces)) for v in values]
    test = text.has_text(F.col("id").cast("string"))
    plan = spark.range(1).select(test.alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.index(">= !") < plan.index("<= ~") < plan.index("RLIKE")


def test_ids(spark):
    args = F.lit("a.py"), F.lit(2), F.lit(5)
    want = hashlib.sha256(b"a.py:2:5:body").hexdigest()
    assert column(spark, ["body"], lambda c: text.snippet_id(*args, c)) == [want[:12]]
    assert column(spark, ["body"], lambda c: text.snippet_id(*args, c, length=64)) == [want]
    given = lambda c: text.snippet_id(*args, F.lit("body"), explicit=c)
    assert column(spark, ["mine", "", None], given) == ["mine", want[:12], want[:12]]


def test_shape(spark):
    assert column(spark, [7], lambda c: text.line_count(F.lit(3), c), "int") == [5]
    assert column(spark, [7], lambda c: text.location(F.lit("d/f.go"), c), "int") == ["d/f.go:7"]


def test_embedding_text(spark):
    made = lambda c: text.embedding_text(F.lit("go"), c, F.lit("x\ny"))
    assert column(spark, ["run", "", None], made) == ["# go\n# run\nx\ny", "# go\nx\ny", "# go\nx\ny"]


def test_header_rounds_like_printf(spark):
    made = lambda c: text.hit_header(
        F.lit(2), c, F.lit("method"), F.lit("A.f"), F.lit("p.py"), F.lit(9), F.lit("abc")
    )
    scores = [0.0625, 0.1875, 0.59, -1.0, 1 / 3, 0.0005, 0.0025, 1.0005, -0.0015, *(k / 2000 for k in range(-200, 200))]
    want = [f"2. [{s:.3f}] method A.f  (p.py:9)  id=abc" for s in scores]
    assert column(spark, scores, made, "double") == want
    bare = lambda c: text.label(F.lit("block"), c)
    assert column(spark, [None], bare) == ["block"]


def test_preview(spark):
    long = "x" * 190 + "　 \t" + "y" * 50
    samples = ["a\nb", "1\n2\n3\n4", "", long, "z" * 196, "z" * 197]

    def model(s):
        t = "\n".join("    " + line for line in s.splitlines()[:3])
        return t[:200].rstrip() + " ..." if len(t) > 200 else t

    assert column(spark, samples, text.preview) == [model(s) for s in samples]
