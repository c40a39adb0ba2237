"""URL filter: a sort-merge range join of reversed-host keys with nested rules.

A host's labels are written in reverse, ``www.example.org`` as ``org.example.www.``, so that a
rule for a host and all its subdomains is an interval of keys. A sweep over the sorted keys of a
batch opens rules as their intervals begin and drops them as they end; the open rules are nested
and lie on a stack. Of those, the longest whose path begins the page's path decides.

The rules travel to the pages, in blocks of bounded size; a pass over the pages per block carries
the best rule so far along, so pages are never shuffled and hot hosts need no care.

Defined results: a null url and one without ``://`` have an empty host and path, which no rule
fits; equal lengths go to the longer host; of a rule stated twice with different verdicts, block
wins; a rule with a null host, path or verdict is left out; an empty rule table gives the default
verdict; a rule host is compared in lower case (A-Z).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one broadcast block.
BLOCK = 200_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return lower_ascii(rest)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substr(rest, at)).otherwise("")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def reversed_host(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split(".")))


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, str, str, str]]) -> list[tuple[str, str] | None]:
    """The deciding (rule, verdict) of each page. ``rules``: (key, host, path, verdict), sorted by key."""
    out: list[tuple[str, str] | None] = [None] * len(keys)
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key prefix, path -> rule, path lengths
    at = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key, path = keys[i], paths[i]
        while at < len(rules) and rules[at][0] <= key:
            start, host, rule_path, verdict = rules[at]
            while stack and not start.startswith(stack[-1][0]):
                stack.pop()
            if not stack or stack[-1][0] != start:
                stack.append((start, {}, []))
            _, by_path, lengths = stack[-1]
            if rule_path not in by_path and len(rule_path) not in lengths:
                lengths.append(len(rule_path))
                lengths.sort(reverse=True)
            if by_path.get(rule_path, ("", ""))[1] != "block":
                by_path[rule_path] = (host + rule_path, verdict)
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best: tuple[str, str] | None = None
        for _, by_path, lengths in reversed(stack):  # the longest host first, so that it wins ties
            for n in lengths:
                found = by_path.get(path[:n]) if n <= len(path) else None
                if found:
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        out[i] = best
    return out


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path as one string) and verdict.

    ``rules``: (host, path, verdict) rows as a list or a frame with those columns. Input columns
    called like one of the four results are replaced.
    """
    frame = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    frame = frame.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    for block in _blocks(rules):
        frame = _judge_block(frame, block)
    return frame


def _blocks(rules: Iterable[tuple[str, str, str]] | DataFrame) -> Iterator[list[tuple[str, str, str, str]]]:
    def keyed(rows: Iterable) -> list[tuple[str, str, str, str]]:
        fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        whole = [(r[0].translate(fold), r[1], r[2]) for r in rows if None not in (r[0], r[1], r[2])]
        return sorted((reversed_host(h), h, p, v) for h, p, v in whole)

    if isinstance(rules, DataFrame):
        table = rules.select("host", "path", "verdict")
        n = -(-table.count() // BLOCK)
        part = F.pmod(F.xxhash64("host", "path"), F.lit(max(1, n)))
        for i in range(n):
            yield keyed(table.where(part == i).distinct().collect())
    else:
        rows = list(rules)
        for i in range(0, len(rows), BLOCK):
            yield keyed(rows[i : i + BLOCK])


def _judge_block(frame: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(rules)
    names, places = frame.columns, [frame.columns.index(c) for c in ("host", "path", "rule", "verdict")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, best, verdicts = (batch.column(i).to_pylist() for i in places)
            found = sweep([reversed_host(h) for h in hosts], paths, shared.value)
            for i, x in enumerate(found):
                if x and (best[i] is None or _before(x, (best[i], verdicts[i]), hosts[i])):
                    best[i], verdicts[i] = x
            columns = list(batch.columns)
            columns[places[2]], columns[places[3]] = pa.array(best, pa.string()), pa.array(verdicts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(run, frame.schema).toDF(*names)


def _before(new: tuple[str, str], old: tuple[str, str], host: str) -> bool:
    """Whether a rule of a later block wins: longer; then the longer host; then block."""
    rank = lambda x: (len(x[0]), len(x[0].partition("/")[0]), x[1] == "block")
    return rank(new) > rank(old)
