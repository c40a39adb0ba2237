"""Language identification by words first, shorter and shorter character n-grams after.

A known word scores by its smoothed log frequency in each language. A word that was not seen in
training scores by its longest character n-grams any of which are known, from five letters (with
a mark at either end) down to one, as the mean of their log frequencies. A text's language has the
highest sum; its score is that language's share after the sums are scaled by the root of the number
of words, so that long texts do not all score 1.

Training reads a bounded sample: about ``SAMPLE`` labelled texts per language, drawn by hash, whole.
The tables hold at most ``MAX_ENTRIES`` words and n-grams, an equal share of them for each language:
those above a count of its own that fits. The rarer words back off. So the model has a fixed bound, whatever the corpus, and travels as a broadcast.

Defined results: a null text and one without letters give ``und`` and score 0, as does any text
where there is nothing to train on; ties go to the first language in order of name; a null doc_id
is not held out, and its row is not trained on; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .batches import few, made_columns, numbered

#: Expected number of labelled texts per language that are trained on.
SAMPLE = 5_000
#: Most words, and most n-grams, that the model holds over all languages.
MAX_ENTRIES = 120_000
LONGEST = 5
WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # word -> row of word_logs
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def tokens(text: str | None) -> list[str]:
    """Runs of letters; numerals such as ² and Ⅳ are none."""
    found = WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: the fifth whose crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = SAMPLE) -> DataFrame:
    """(lang, text) of about ``size`` texts per language that are neither held out nor unlabelled."""
    usable = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    there = usable.groupBy(F.col(lang).alias("sample_lang")).agg(F.count("*").alias("sample_n"))
    there = few(there)  # one row per language: texts stay where they are
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 20)) / float(1 << 20)
    rows = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    return rows.join(there, F.col("lang") == F.col("sample_lang")).where(F.col("draw") * F.col("sample_n") < size).select("lang", "text")


def fit(sample: DataFrame, max_entries: int = MAX_ENTRIES) -> Model:
    """Model of a bounded sample with columns lang and text."""
    spark, shape = sample.sparkSession, "lang string, gram string, n long"
    folder = scratch_folder(spark)

    def counted(batches: Iterator[pa.RecordBatch], count: Callable[[Counter, dict], None]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for row in batch.to_pylist():
                count(seen, row)
            columns = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    def words_of(seen: Counter, row: dict) -> None:
        seen.update((row["lang"], w) for w in tokens(row["text"]))

    def grams_of(seen: Counter, row: dict) -> None:
        for size in range(1, LONGEST + 1):
            for g in grams(row["gram"], size):
                seen[row["lang"], g] += row["n"]

    def added_up(rows: DataFrame, name: str) -> DataFrame:
        rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    words = added_up(sample.select("lang", "text").mapInArrow(lambda x: counted(x, words_of), shape), "words")
    # n-grams are those of all words, also of words too rare for a row of their own
    letters = added_up(words.mapInArrow(lambda x: counted(x, grams_of), shape), "grams")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    at = {x: i for i, x in enumerate(langs)}
    found = []
    for rows_of in (words, letters):
        table = _frequent(rows_of, max_entries).toArrow()
        places: dict[str, int] = {}
        rows = np.fromiter((places.setdefault(g, len(places)) for g in table.column("gram").to_pylist()), np.int64, len(table))
        counts = np.zeros((len(places), len(langs)))
        counts[rows, [at[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
        logs = np.log(counts + 0.5) - np.log(counts.sum(0, keepdims=True) + 0.5 * len(places) + 1) if len(places) else counts
        found.append((places, logs.astype(np.float32)))
    return Model(langs, *found[0], *found[1])


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of at most ``most`` words or n-grams, an equal share for each language.

    A language's share is all whose count in it is above a threshold of its own.
    """
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in counted.groupBy("lang", "n").agg(F.count("*").alias("m")).collect():  # far fewer than tokens
        counts.setdefault(r["lang"], []).append((r["n"], r["m"]))
    least = {}
    for lang, own in counts.items():
        room, least[lang] = most // len(counts), 1
        for n, m in sorted(own, reverse=True):
            room -= m
            if room < 0:
                least[lang] = n + 1
                break
    limits = counted.sparkSession.createDataFrame(list(least.items()), "limit_lang string, least long")
    frequent = counted.join(F.broadcast(limits), F.col("lang") == F.col("limit_lang")).where("n >= least").select("gram").distinct()
    return counted.join(frequent, "gram").select("gram", "lang", "n")


def predict(model: Model, text: str | None, memo: dict[str, list[int]]) -> tuple[str, float]:
    """Language and score of one whole text. ``memo`` keeps the n-grams that unseen words back off to."""
    found = tokens(text)
    if not found or not model.langs:
        return "und", 0.0
    known, rows, sizes = [], [], []
    for word in found:
        row = model.words.get(word)
        if row is not None:
            known.append(row)
            continue
        own = memo.get(word)
        if own is None:
            own = memo[word] = backoff(model, word)
        if own:
            rows += own
            sizes.append(len(own))
    total = model.word_logs[known].sum(0, dtype=np.float64) if known else np.zeros(len(model.langs))
    if rows:
        # each word counts with the mean of its n-grams
        total += np.repeat(1 / np.array(sizes), sizes) @ model.gram_logs[rows]
    scaled = total / math.sqrt(max(len(known) + len(sizes), 1))
    best = int(scaled.argmax())
    return model.langs[best], float(1 / np.exp(scaled - scaled[best]).sum())


def backoff(model: Model, word: str) -> list[int]:
    """The known n-grams of a word, of the greatest length of which there are any."""
    get = model.grams.get
    for n in range(min(LONGEST, len(word) + 2), 0, -1):
        marked = f"<{word}>" if n > 1 else word
        rows = [r for i in range(len(marked) - n + 1) if (r := get(marked[i : i + n])) is not None]
        if rows:
            return rows
    return []


def with_language(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with lang_pred and score, over whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[list]:
        memo: dict[str, list[int]] = {}
        out = [predict(shared.value, t, memo) for t in texts]
        return [[x[0] for x in out], [x[1] for x in out]]

    return made_columns(documents, [text], "lang_pred string, score double", run, keep)


def filter_language(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_score: float = 0.4) -> DataFrame:
    """Documents whose language can be told, with their own columns.

    Rejected are null texts, texts without letters, and those that fit no learned language better
    than ``min_score`` (with one or no language there is nothing to tell apart).
    """
    model = fit(training_sample(documents, text, lang, doc_id))
    rows, names, back = numbered(documents)
    judged = with_language(rows, model, names[text])
    letters = F.coalesce(F.regexp_like(names[text], F.lit(r"\p{L}")), F.lit(False))
    keep = letters if not model.langs else letters & (F.col("lang_pred") != "und") & (F.col("score") >= min_score)
    return judged.where(keep).select(*back)
