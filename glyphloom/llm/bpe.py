"""Byte-level BPE by replaying the merges over a block of texts at once.

A block's distinct words (matches of the split pattern) lie end to end in one array of tokens with
links to their neighbours. An index from token pair to the places where it stands, kept by the rank
of the merge it allows, is worked off in rank order: all places of the lowest rank are merged
together, then only the pairs on either side of a merged place are looked up again and enter the
index. The ids of the words are then laid out text by text.

Words are encoded independently of each other, so blocks need not know of each other: the step is
narrow, with no shuffle and no table that grows with the corpus.

Ranks are those of the given vocabulary file; a pair is allowed whenever its bytes are a token,
whatever pair the token was trained from. Defined results: null and empty texts have no ids; text
of any length is taken whole; repeated rows are encoded as often as they occur.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import made_columns

#: Characters of text whose words are merged together.
BLOCK = 4_000_000
NONE = np.int64(1) << 40

# The split pattern in terms of Python's own classes, for texts in which both agree: no numerals
# other than decimal digits, no file separators. Two times faster than the general one.
PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps for its next blocks.
KEPT = 200_000


@lru_cache(maxsize=1)
def _peculiar() -> frozenset[str]:
    """Characters that Python's classes and the pattern's take for different things."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    pairs = ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))
    differing = (set(re.findall(a, every)) ^ set(regex.findall(b, every)) for a, b in pairs)
    return frozenset().union(*differing, "\x1c\x1d\x1e\x1f")


class Merges:
    """Vocabulary and pair tables, built from rank lines (base64 bytes, space, rank)."""

    def __init__(self, lines: Iterable[bytes], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.plain = PLAIN if pattern == PLAIN_FOR else None
        rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pieces = [b""] * (max(rank.values()) + 1)
        for piece, r in rank.items():
            self.pieces[r] = piece
        self.bytes = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {(rank[p[:i]], rank[p[i:]]): r for p, r in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank}
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(pairs.values()), np.int64)[order]
        # tokens that allow a pair of lower rank than their own: their merges go one by one
        low = np.zeros(len(self.pieces), bool)
        for (a, b), r in pairs.items():
            low[a] |= r < a
            low[b] |= r < b
        self.low = low
        self.byte_pairs = self.pair_ranks(*(x.ravel() for x in np.meshgrid(self.bytes, self.bytes, indexing="ij"))).reshape(256, 256)
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def split(self, text: str) -> list[str]:
        if self.plain is not None and _peculiar().isdisjoint(set(text)):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the place where each word's begin (one more at the end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        token = self.bytes[raw]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = ends[lengths > 0]
        after[filled - 1] = -1
        before[filled[:-1]] = -1
        if n:
            before[0] = -1
        word_end = np.repeat(ends, lengths)
        rank = np.full(n, NONE)
        pairs = np.flatnonzero(after >= 0)
        rank[pairs] = self.byte_pairs[raw[pairs], raw[pairs + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            of = rank[places]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for r, group in zip(of[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(group)

        enter(pairs)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if len(at) > 1:
                at.sort()
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            if not len(at):
                continue
            if len(at) > 1:
                if self.low[r]:
                    later = np.concatenate(([False], word_end[at[1:]] == word_end[at[:-1]]))
                else:
                    later = _every_second(at, after)
                if later.any():
                    waiting, at = at[later], at[~later]
                    if self.low[r]:
                        enter(waiting)
            right = after[at]
            token[at], rank[right], token[right] = r, NONE, -1
            behind = after[right]
            after[at] = behind
            inner = behind >= 0
            before[behind[inner]] = at[inner]
            rank[at] = NONE
            rank[at[inner]] = self.pair_ranks(token[at[inner]], token[behind[inner]])
            front = before[at]
            outer = front >= 0
            front = front[outer]
            rank[front] = self.pair_ranks(token[front], token[at[outer]])
            enter(np.concatenate((at[inner], front)))
        alive = token >= 0
        places = np.concatenate(([0], np.cumsum(alive)))
        return token[alive], places[np.concatenate(([0], ends))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the place where each text's begin (one more at the end)."""
        known, old = self.known, len(self.known)
        known.default_factory = count(old).__next__
        words = array("i")
        sizes = []
        for text in texts:
            there = len(words)
            words.extend(map(known.__getitem__, self.split(text)))
            sizes.append(len(words) - there)
        new, new_begin = self.replay([w.encode("utf-8", "surrogatepass") for w in islice(known, old, None)])
        ids, begin = np.concatenate((self.ids, new.astype(np.int32))), np.concatenate((self.begin, new_begin[1:] + len(self.ids)))
        for word in list(islice(known, KEPT, None)):
            del known[word]
        self.ids, self.begin = ids[: begin[len(known)]], begin[: len(known) + 1]
        used = np.frombuffer(words, np.int32)
        lengths = (begin[1:] - begin[:-1])[used]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        gathered = ids[np.repeat(begin[used] - (ends - lengths), lengths) + np.arange(total)]
        text_ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
        return gathered, text_ends

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _every_second(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap (``aaa``), every second from the left: those that cannot merge."""
    touches = np.concatenate(([False], after[at[:-1]] == at[1:]))
    begin = np.maximum.accumulate(np.where(touches, 0, np.arange(len(at))))
    return (np.arange(len(at)) - begin) % 2 == 1


@lru_cache(maxsize=2)
def _merges(lines: bytes, pattern: str) -> Merges:
    return Merges(lines.splitlines(), pattern)


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """Broadcast of a rank file (a fixed size), given by a path that the driver can open."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def with_ids(documents: DataFrame, vocabulary: Broadcast, text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``documents`` with ``ids``, the token ids of the whole text."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        merges, parts, sizes, at = _merges(*vocabulary.value), [], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            stop, room = at, block
            while stop < len(texts) and (stop == at or len(texts[stop] or "") <= room):
                room -= len(texts[stop] or "")
                stop += 1
            ids, ends = merges.encode([t or "" for t in texts[at:stop]])
            parts.append(ids.astype(np.int32))
            sizes.append(np.diff(ends))
            at = stop
        offsets = np.cumsum(np.concatenate(sizes))
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return made_columns(documents, [text], "ids array<int>", run, keep)


def with_decoded(encoded: DataFrame, vocabulary: Broadcast, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the ids stand for (null ids: none)."""

    def run(rows: pa.ListArray) -> list[list[bytes]]:
        merges = _merges(*vocabulary.value)
        return [[merges.decode(r.values.to_pylist() if r.is_valid else ()) for r in rows]]  # one row's ids at a time

    return made_columns(encoded, [ids], "decoded binary", run, keep, lists=False)


def digests(encoded: DataFrame, vocabulary: Broadcast, id_column: str = "doc_id") -> DataFrame:
    """Number of ids, and digests of the ids and of what they decode to."""
    decoded = with_decoded(encoded, vocabulary, keep=[id_column, "ids"])
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(id_column, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
