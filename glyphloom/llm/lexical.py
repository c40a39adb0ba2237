"""Ranked lexical search over bit-sliced Bloom signatures.

A document's terms are hashed into a signature of so many bits that few are set. Signatures of
equally wide documents lie side by side in blocks, cut into slices: slice j is a bitmap over the
block's documents, of those that have bit j. The slices of a term, taken together with AND, give the
documents that may hold it: all that do, and a few more. Frequent terms enter the signature again
for every ``LEVELS`` count they reach, under another hash each, so the slices also bound how often
a term may occur. Summed by the weights of an item's terms they bound each document's score from
above.

The best documents by bound are scored on their texts; the k-th of these scores is a threshold that
the final k-th cannot fall below. Then every document whose bound reaches an item's threshold is
scored on its text. All others are proven to rank lower, so the result is exact.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's
norm m is 25 + (75 n N) div L; the score sums weight * ((10^9 tf) div (1000 tf + 8 m)) over the
item's terms, repeats included.

Documents stay where they are: signatures are made in one narrow pass, and only the keys of
candidates travel. Items go out in blocks of bounded size, whose vocabulary is broadcast; each
block's frequencies are counted along with the signatures.

Defined results: null and empty texts have no terms, are not counted and never found; an item
without terms finds nothing; rows that repeat a document each take a rank; among equal scores the
smaller doc_id comes first, null ones last; repeated items are answered as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folders
from ..sources.scratch import scratch_folder
from .batches import few

SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Bytes to themselves, A-Z to a-z, and everything between terms to a space.
TO_TERMS = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Counts from which a term enters the signature once more.
LEVELS = (1, 2, 4, 8)
HASHES = 3
#: Bits of a signature for each entry, at least; widths are powers of two within bounds.
BITS_PER_ENTRY, MIN_WIDTH, MAX_WIDTH = 8, 256, 1 << 20
#: Bits of a block of signatures, at most, and its rows.
BLOCK_BITS, BLOCK_ROWS = 1 << 23, 2_048
#: Characters of items that are searched together.
ITEM_CHARS = 4_000_000
#: Items whose bounds are held at the same time.
ITEMS_AT_ONCE = 256
TERM_MEMO = 500_000
#: So many times k documents of an item are scored to find its threshold.
FIRST = 4

BLOCKS = "width int, ids array<long>, prints array<long>, sizes array<long>, most array<long>, slices binary, terms array<int>, holding array<long>, texts long, length long"
KEY = "doc_id long, print long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_TERMS).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bits of each hashed term at a level: ``HASHES`` columns."""
    own = mixed(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.stack([own >> np.uint64(21 * i) & np.uint64(width - 1) for i in range(HASHES)], 1).astype(np.int64)


def factor(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by; grows with tf."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


@dataclass
class Items:
    """A block of items: their numbers, and for each its terms' places in the vocabulary with repeats."""

    vocabulary: dict[bytes, int]
    own: list[tuple[np.ndarray, np.ndarray]]  # (places, how often)

    @staticmethod
    def of(texts: list[str | None]) -> Items:
        vocabulary: dict[bytes, int] = {}
        own = []
        for text in texts:
            counted = Counter(terms(text))
            at = [vocabulary.setdefault(t, len(vocabulary)) for t in counted]
            own.append((np.array(at, np.int64), np.array(list(counted.values()), np.int64)))
        return Items(vocabulary, own)

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(t) for t in self.vocabulary], np.uint64)


@dataclass
class Scoring:
    """Numbers of the whole corpus, and the terms' weights by their place in the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        # Python's whole numbers where 75 n N would not fit
        if len(sizes) and 75 * int(sizes.max()) * self.documents >= 1 << 63:
            return np.array([25 + 75 * n * self.documents // self.length for n in sizes.tolist()], np.int64)
        return 25 + 75 * sizes * self.documents // max(self.length, 1)


# -- signatures ----------------------------------------------------------------------


def _sliced(own: list[tuple], width: int) -> np.ndarray:
    """Slices of a block: a row for each bit, the documents' bits side by side."""
    held = np.zeros((width, len(own)), np.uint8)
    hashes, counts = (np.concatenate([r[i] for r in own]) for i in (3, 4))
    column = np.repeat(np.arange(len(own)), [len(r[3]) for r in own])
    for level, least in enumerate(LEVELS):
        reached = counts >= least
        held[places(hashes[reached], level, width), column[reached, None]] = 1
    return np.packbits(held, axis=1, bitorder="little")


def _signatures(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows (doc_id, print, text); the first block of a batch has its counts."""
    vocabulary, memo = shared.value.vocabulary, {}
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            ids, prints, texts = whole.slice(at, BLOCK_ROWS).columns
            rows = defaultdict(list)  # width -> (row, tokens, highest count, hashes, counts)
            holding: Counter[int] = Counter()
            n_texts = length = 0
            for i, text in enumerate(texts):
                found = terms(text.as_py())
                if not found:
                    continue
                counted = Counter(found)
                n_texts, length = n_texts + 1, length + len(found)
                holding.update(vocabulary[t] for t in counted.keys() & vocabulary.keys())
                if len(memo) > TERM_MEMO:
                    memo.clear()
                hashes = np.empty(len(counted), np.uint64)
                for j, t in enumerate(counted):
                    h = memo.get(t)
                    if h is None:
                        h = memo[t] = xxhash.xxh64_intdigest(t)
                    hashes[j] = h
                counts = np.fromiter(counted.values(), np.int64, len(counted))
                entries = sum(int((counts >= n).sum()) for n in LEVELS)
                width = min(max(1 << (BITS_PER_ENTRY * entries - 1).bit_length(), MIN_WIDTH), MAX_WIDTH)
                rows[width].append((i, len(found), int(counts.max()), hashes, counts))
            made = []
            for width, own in rows.items():
                step = max(8, BLOCK_BITS // width)
                made += [(width, own[x : x + step]) for x in range(0, len(own), step)]
            for number, (width, own) in enumerate(made):
                slices, row = _sliced(own, width), [r[0] for r in own]
                tally = sorted(holding.items()) if not number else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([width], pa.int32()),
                        pa.array([ids.take(pa.array(row)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([prints.take(pa.array(row)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([[r[1] for r in own]], pa.list_(pa.int64())),
                        pa.array([[r[2] for r in own]], pa.list_(pa.int64())),
                        pa.array([slices.tobytes()], pa.binary()),
                        pa.array([[t for t, _ in tally]], pa.list_(pa.int32())),
                        pa.array([[n for _, n in tally]], pa.list_(pa.int64())),
                        pa.array([0 if number else n_texts], pa.int64()),
                        pa.array([0 if number else length], pa.int64()),
                    ],
                    names=["width", "ids", "prints", "sizes", "most", "slices", "terms", "holding", "texts", "length"],
                )


def write_signatures(documents: DataFrame, items: Broadcast, folder: str) -> DataFrame:
    """The signature blocks of (doc_id, print, text), with the counts of the items' terms; written to ``folder``."""
    documents.mapInArrow(lambda batches: _signatures(batches, items), BLOCKS).write.parquet(folder)
    return documents.sparkSession.read.schema(BLOCKS).parquet(folder)


def scoring(blocks: DataFrame, items: Items) -> Scoring:
    """Numbers of the corpus; reads the blocks' counts only. The vocabulary has a bounded size."""
    n, length = blocks.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    holding = np.zeros(len(items.vocabulary), np.int64)
    tally = blocks.select(F.explode(F.arrays_zip("terms", "holding")).alias("x")).groupBy("x.terms").agg(F.sum("x.holding").alias("n"))
    for r in tally.collect():
        holding[r["terms"]] = r["n"]
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in holding.tolist()]
    return Scoring(int(n), int(length), np.array(weights, np.int64))


# -- bounds --------------------------------------------------------------------------


def _bounds(slices: np.ndarray, sizes: np.ndarray, most: np.ndarray, picked: list[np.ndarray], items: Items, own: Scoring, first: int) -> np.ndarray:
    """Upper bounds of the scores: a row for each of ``ITEMS_AT_ONCE`` items from ``first`` on, a column for each document."""
    norm, rows = own.norms(sizes), len(sizes)
    # the highest count below the next level, or the document's highest, and what it adds to the bound
    reached = [factor(np.minimum(n - 1, most), norm) for n in (*LEVELS[1:], 1 << 40)]
    gains = [reached[0], *(b - a for a, b in zip(reached, reached[1:], strict=False))]
    chosen = items.own[first : first + ITEMS_AT_ONCE]
    used = np.unique(np.concatenate([at for at, _ in chosen] or [np.empty(0, np.int64)]))
    bounds = np.zeros((len(chosen), rows), np.int64)
    for level in range(len(LEVELS)):
        both = np.bitwise_and.reduce([slices[picked[level][used, i]] for i in range(HASHES)])
        held = np.unpackbits(both, axis=1, bitorder="little")[:, :rows]
        for i, (at, often) in enumerate(chosen):
            if len(at):
                bounds[i] += ((own.weights[at] * often) @ held[np.searchsorted(used, at)]) * gains[level]
    return bounds


def _each_block(batches: Iterator[pa.RecordBatch], items: Items, own: Scoring) -> Iterator[tuple]:
    hashes, picked = items.hashes(), {}
    for batch in batches:
        for width, ids, prints, sizes, most, slices in zip(*(batch.column(i) for i in range(6)), strict=True):
            bits = width.as_py()
            if bits not in picked:
                picked[bits] = [places(hashes, level, bits) for level in range(len(LEVELS))]
            cut = np.frombuffer(slices.as_buffer(), np.uint8).reshape(bits, -1)
            numbers = [x.values.to_numpy(zero_copy_only=False) for x in (sizes, most)]
            for first in range(0, len(items.own), ITEMS_AT_ONCE):
                yield first, ids.values, prints.values, _bounds(cut, *numbers, picked[bits], items, own, first)


def best_bounds(blocks: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """Keys of each item's k documents with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own = shared.value
        best: dict[int, list] = defaultdict(list)
        for first, ids, prints, bounds in _each_block(batches, items, own):
            for i, row in enumerate(bounds):
                top = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                least = best[first + i][-1][0] if len(best[first + i]) == k else 0
                top = top[row[top] > least]
                if len(top):
                    best[first + i] += [(int(row[j]), ids[j].as_py(), prints[j].as_py()) for j in top.tolist()]
                    best[first + i] = sorted(best[first + i], key=lambda x: -x[0])[:k]
        rows = [(q, *x) for q, found in best.items() for x in found]
        if rows:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "bound", "doc_id", "print"])

    found = blocks.select("width", "ids", "prints", "sizes", "most", "slices").mapInArrow(run, f"q long, bound long, {KEY}")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound")))
    return found.withColumn("place", place).where(F.col("place") <= k).select("doc_id", "print").distinct()


def not_excluded(blocks: DataFrame, shared: Broadcast, least: np.ndarray) -> DataFrame:
    """Keys of all documents whose bound reaches the threshold of some item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own = shared.value
        for first, ids, prints, bounds in _each_block(batches, items, own):
            reach = np.flatnonzero((bounds >= least[first : first + len(bounds), None]).any(0))
            if len(reach):
                at = pa.array(reach)
                yield pa.RecordBatch.from_arrays([ids.take(at), prints.take(at)], names=["doc_id", "print"])

    found = blocks.select("width", "ids", "prints", "sizes", "most", "slices").mapInArrow(run, KEY)
    return found.distinct()


# -- exact scores --------------------------------------------------------------------


def best_scores(documents: DataFrame, keys: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """(q, doc_id, score): each item's k best among the documents with the given keys, scored on their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own = shared.value
        used = [x for x in range(len(items.own)) if len(items.own[x][0])]
        if not used:
            return
        at = np.concatenate([items.own[x][0] for x in used])
        often = np.concatenate([items.own[x][1] for x in used])
        begin = np.cumsum([0, *(len(items.own[x][0]) for x in used[:-1])])
        numbers, last = np.array(used), np.iinfo(np.int64).max
        best: dict[int, list] = defaultdict(list)
        least = np.zeros(len(used), np.int64)  # below or at it nothing enters an item's k best
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                found, doc_id = terms(text.as_py()), doc_id.as_py()
                counts = np.zeros(len(items.vocabulary), np.int64)
                for t, n in Counter(found).items():
                    place = items.vocabulary.get(t)
                    if place is not None:
                        counts[place] = n
                norm = own.norms(np.array([len(found)]))
                scores = np.add.reduceat((own.weights * factor(counts, norm))[at] * often, begin)
                for i in np.flatnonzero((scores > 0) & (scores >= least)).tolist():
                    rows = best[i]
                    rows.append((-int(scores[i]), last if doc_id is None else doc_id, doc_id))
                    if len(rows) >= 2 * k:
                        rows.sort(key=lambda x: x[:2])
                        del rows[k:]
                        least[i] = -rows[-1][0]
        rows = [(int(numbers[i]), x[2], -x[0]) for i, own_rows in best.items() for x in sorted(own_rows, key=lambda x: x[:2])[:k]]
        if rows:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "doc_id", "score"])

    wanted = few(keys.select(F.col("doc_id").alias("wanted_id"), F.col("print").alias("wanted_print")))
    match = documents["doc_id"].eqNullSafe(F.col("wanted_id")) & (documents["print"] == F.col("wanted_print"))
    found = documents.join(wanted, match, "left_semi").select("doc_id", "text").mapInArrow(run, "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(documents: DataFrame, rows: list, k: int, folder: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items ``rows`` (item_id, text)."""
    spark: SparkSession = documents.sparkSession
    context = spark.sparkContext
    items = Items.of([r[1] for r in rows])
    shared_items = context.broadcast(items)
    blocks = write_signatures(documents, shared_items, f"{folder}/signatures")
    shared = context.broadcast((items, scoring(blocks, items)))

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    first = stored(best_bounds(blocks, shared, FIRST * k), "first")
    least = np.ones(len(items.own), np.int64)  # scores above 0 only
    for r in best_scores(documents, first, shared, k).where(F.col("rank") == k).select("q", "score").collect():
        least[r["q"]] = r["score"]
    candidates = stored(not_excluded(blocks, shared, least), "candidates")
    found = stored(best_scores(documents, candidates, shared, k), "found")
    for name in ("signatures", "first", "candidates"):
        folders.remove(spark, f"{folder}/{name}")
    shared.destroy()
    shared_items.destroy()
    numbers = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "number long, item_id long")
    joined = found.join(F.broadcast(numbers), F.col("q") == F.col("number"))
    return joined.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(documents: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above 0 for each row of ``items``.

    Items are searched in blocks of about ``item_chars`` characters, dealt by hash; a block's items
    are read to the driver.
    """
    spark, folder = documents.sparkSession, scratch_folder(documents.sparkSession)
    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // item_chars))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    dealt.write.parquet(f"{folder}/items")
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/items")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).select("item_id", "text").collect()
        if rows:
            out = out.unionByName(_search_block(given, rows, k, f"{folder}/{b}"))
    return out
