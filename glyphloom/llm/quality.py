"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gives counts (words, symbols, repeated lines, repeated passages) and from them four
whole-number measures. A sketch per language, source and measure counts the documents in buckets
whose width is 1/32 of their value or less, so a quantile is known to about 3 %. Sketches merge by
adding counts: Spark adds them up before its shuffle, a hot source costs no more than a small one,
and the sketch of a language or of everything is the sum of its parts. Sketches hold the documents that
pass the base rules. Fences follow from the quartiles of the group, and a join brings them to its
documents. Repeated lines and passages are absent from most documents, so that their quartiles say
little: their fence is no lower than the value that 99 of 100 documents of the group do not exceed.

Defined results: null and empty texts have no words and fail; a null language or source is a group
of its own; repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .batches import few, made_columns, numbered

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents below which a group uses the sketch of its language, and that one the sketch of all.
MIN_GROUP = 100
#: Fence: quartile and so many quartile distances; the distance counts as at least ``slack``.
SPREAD = 6
#: measure -> (slack of the quartile distance, whether low values fail too, whether the fence is at the tail or above)
MEASURES = {"word_length": (100, True, False), "symbols": (10, False, False), "dup_lines": (30, False, True), "repeats": (15, False, True)}
#: Documents of 100 that a fence at the tail leaves inside.
TAIL = 99
COUNT_NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
COUNTS = ", ".join(f"{c} long" for c in COUNT_NAMES)


def repeat_words(words: list[str]) -> int:
    """Words in windows of eight that occur at least twice. Windows get equal numbers only if they are equal."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    for step in (1, 2, 4):
        ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    words = WORD.findall(text or "")
    if not words:
        return (0, 0, len(SYMBOL.findall(text or "")), 0, 0, 0)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def with_counts(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with the columns of COUNTS, over whole texts."""
    return made_columns(documents, [text], COUNTS, lambda texts: list(zip(*map(text_counts, texts), strict=True)) or [[]] * 6, keep)


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def measures() -> dict[str, Column]:
    """Whole numbers: word length and the shares of symbols, repeated lines and words, each per 1,000 or 100."""
    share = lambda a, b, unit: F.expr(f"CAST({unit} * {a} DIV greatest({b}, 1) AS BIGINT)")
    return {
        "word_length": share("word_chars", "n_words", 100),
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
    }


def bucket(v: Column) -> Column:
    """Bucket of a whole number: itself below 64, then 32 buckets for each power of two."""
    bits = F.length(F.bin(v))
    scaled = F.call_function("shiftright", v, (bits - 6).cast("int"))
    return F.when(v < 64, v).otherwise((bits - 5) * 32 + scaled - 32).cast("int")


def bucket_floor(b: Column) -> Column:
    """Least value of a bucket."""
    power = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b % 32 + 32).cast("long"), power.cast("int"))).cast("long")


def sketches(counted: DataFrame, by: list[str]) -> DataFrame:
    """Documents per group, measure and bucket: the sketches. Rows of equal keys merge by adding n."""
    cells = F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures().items()))
    rows = counted.where("n_words > 0").select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    return rows.groupBy(*by, "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group and measure: documents, first and third quartile (least value of their bucket), tail (greatest one)."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    # a group has at most some hundreds of buckets per measure, however many documents it has
    cells = merged.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("docs"))

    def at(share: int) -> Column:
        """The bucket with the first cumulated count of share hundredths of the documents or more."""
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found"))

        def step(state: Column, cell: Column) -> Column:
            seen = state["seen"] + cell["n"]
            found = F.when(state["found"].isNull() & (100 * seen >= share * F.col("docs")), cell["bucket"]).otherwise(state["found"])
            return F.struct(seen.alias("seen"), found.alias("found"))

        return F.aggregate("cells", zero, step, lambda s: s["found"])

    found = {"q1": bucket_floor(at(25)), "q3": bucket_floor(at(75)), "tail": bucket_floor(at(TAIL) + 1) - 1}
    return cells.select(*by, "measure", "docs", *(v.alias(k) for k, v in found.items()))


def fences(counted: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """Per language and source: ``low_<measure>`` and ``high_<measure>``, outside of which a document fails."""
    sketch = sketches(counted.where(~base_failed()).select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *COUNT_NAMES), ["g_lang", "g_source"])
    own = quartiles(sketch, ["g_lang", "g_source"])
    wider = quartiles(sketch, ["g_lang"]).select(F.col("g_lang").alias("w_lang"), F.col("measure").alias("w_measure"), F.struct("docs", "q1", "q3", "tail").alias("w"))
    widest = quartiles(sketch, []).select(F.col("measure").alias("a_measure"), F.struct("docs", "q1", "q3", "tail").alias("a"))
    rows = own.join(wider, F.col("g_lang").eqNullSafe(F.col("w_lang")) & (F.col("measure") == F.col("w_measure")))
    rows = rows.join(widest, F.col("measure") == F.col("a_measure"))
    mine = F.struct("docs", "q1", "q3", "tail")
    used = F.when(F.col("docs") >= min_group, mine).when(F.col("w.docs") >= min_group, F.col("w")).otherwise(F.col("a"))
    rows = rows.select("g_lang", "g_source", "measure", used.alias("u"))
    sides = []
    for name, (slack, two_sided, tail) in MEASURES.items():
        spread = SPREAD * F.greatest(F.col("u.q3") - F.col("u.q1"), F.lit(slack))
        here, high = F.col("measure") == name, F.col("u.q3") + spread
        high = F.greatest(high, F.col("u.tail")) if tail else high
        sides.append(F.max(F.when(here, high)).alias(f"high_{name}"))
        if two_sided:
            # shares cannot fall below nothing; a length fails below half its first quartile
            sides.append(F.max(F.when(here, F.expr("u.q1 DIV 2"))).alias(f"low_{name}"))
    return rows.groupBy("g_lang", "g_source").agg(*sides)


def with_verdict(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with base_failed and kept. ``limits``: of ``fences``."""
    inside = F.lit(True)
    for name, value in measures().items():
        inside &= value <= F.col(f"high_{name}")
        if MEASURES[name][1]:
            inside &= value >= F.col(f"low_{name}")
    match = counted[lang].eqNullSafe(limits["g_lang"]) & counted[source].eqNullSafe(limits["g_source"])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return counted.join(limits, match, "left").withColumn("base_failed", base_failed()).withColumn("kept", kept).drop(*limits.columns)


def judge_quality(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the columns of COUNTS, base_failed and kept of every row. Texts are read once."""
    spark = documents.sparkSession
    folder = f"{scratch_folder(spark)}/counts"
    given = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    with_counts(given, keep=["doc_id", "lang", "source"]).write.parquet(folder)
    counted = spark.read.parquet(folder)
    return with_verdict(counted, fences(counted)).select("doc_id", *COUNT_NAMES, "base_failed", "kept")


def filter_quality(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns. Counts are taken twice, so nothing is stored."""
    # one row per language and source: texts stay where they are
    limits = few(fences(with_counts(documents, text, [lang, source]), lang, source))
    rows, names, back = numbered(documents)
    judged = with_verdict(with_counts(rows, names[text]), limits, names[lang], names[source])
    return judged.where("kept").select(*back)
