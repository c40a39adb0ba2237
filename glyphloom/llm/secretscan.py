"""Secrets in texts, among them strings that a tokenizer finds costly.

Three base kinds are found by their shape: an assignment to a name such as ``password`` or
``api_key``, an access key id, and a long hexadecimal number. Each is leftmost and non-overlapping
on its own; matches that are too short are dropped and not tried again.

The method adds ``random``: runs of base64 characters, 20 or more, that cost a public byte-level
vocabulary much: words and names take several characters a token, random strings one or two. A run
of at most ``RATIO`` characters a token counts, unless it is a known form: a digest (hexadecimal of a
usual length), a UUID, or an identifier, whose parts between separators are numbers, words (camel
case allowed) and words with a number behind. Runs that a base span overlaps are not added again.

Spans are counted in code points, end exclusive. Defined results: null and empty texts have no
spans; texts are read whole, whatever their length (runs are encoded in pieces of 4,096 characters,
which keeps the step linear); repeated rows are read as often as they occur.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache

import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import made_columns

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
SPANS = "array<struct<kind: string, start: int, end: int>>"
Span = tuple[str, int, int]

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

#: Least length of a run, and most characters a token that it may have.
MIN_RUN, RATIO = 20, 2.0
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
PIECE = 4_096
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
SEPARATOR = re.compile(r"[+/_=-]+")
PART = re.compile(r"([A-Za-z]*)[0-9]*")
CASED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Mean letters of the pieces of a name in camel case; a random one changes case every other letter.
MEAN_PIECE = 3.5


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def identifier(run: str) -> bool:
    """Whether every part between separators is a number, a word, or a word with a number behind."""
    for part in SEPARATOR.split(run):
        m = PART.fullmatch(part)
        if not m:
            return False
        if m[1] and len(m[1]) / len(CASED.findall(m[1])) < min(MEAN_PIECE, len(m[1])):
            return False
    return True


def known_form(run: str) -> bool:
    bare = run.strip("+/_=-")
    return bool((len(bare) in DIGEST_LENGTHS and DIGEST.fullmatch(bare)) or UUID.fullmatch(bare) or identifier(run))


def find_spans(text: str | None, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[Span]:
    """All (kind, start, end), by start and then by kind as listed in KINDS."""
    if not text:
        return []
    found = base_spans(text)
    covered = sorted((a, b) for _, a, b in found)
    reach, furthest = [], 0  # the furthest end of the base spans up to each
    for _, b in covered:
        furthest = max(furthest, b)
        reach.append(furthest)
    for m in RUN.finditer(text):
        start, end = m.span()
        before = bisect_right(covered, (end - 1, len(text) + 1))
        if (before and reach[before - 1] > start) or known_form(m[0]):
            continue
        pieces = [m[0][i : i + PIECE] for i in range(0, end - start, PIECE)]
        if end - start <= ratio * sum(len(encoding.encode_ordinary(p)) for p in pieces):
            found.append(("random", start, end))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], rank[s[0]]))


@lru_cache(maxsize=2)
def _encoding(lines: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """Broadcast of a rank file (a fixed size), given by a path that the driver can open."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def with_spans(documents: DataFrame, vocabulary: Broadcast, text: str = "text", keep: list[str] | None = None, ratio: float = RATIO) -> DataFrame:
    """``documents`` with ``spans``, the secrets of the whole text."""

    def run(texts: list[str | None]) -> list[list]:
        encoding = _encoding(*vocabulary.value)
        return [[[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, encoding, ratio)] for t in texts]]

    return made_columns(documents, [text], f"spans {SPANS}", run, keep)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
