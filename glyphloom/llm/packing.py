"""Best-fit packing of texts into fixed-size bins, under conflicts.

A bin takes at most one text of a source and one of a duplicate cluster. Pieces are placed in order
of falling length. The open bins lie in order of their residual room; the search starts at the
smallest residual that holds the piece and goes on to the successor until it meets a bin whose
bitmaps of sources and clusters have neither the piece's source nor its cluster. A text longer than
a bin fills whole bins with its first pieces; the last piece is packed like any other.

The rows are dealt by hash into shards of bounded size, which are packed apart; a hot source or
cluster is spread over all of them. A shard with more pieces than the bound (repeated rows hash
alike) is packed in chunks of the bound, one after the other, so a task's memory is bounded.

Defined results: null and empty texts give one piece of length 0, packed like any other; a null
source conflicts with nothing, nor does a null cluster; ties in length go by doc_id, nulls first,
then by piece; repeated rows are packed as often as they occur; an empty table has no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that are packed together.
SHARD = 4_096
CAPACITY = 8_192


def best_fit(pieces: list[tuple[int, str | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), given in order of falling length."""
    bits: list[dict] = []
    for i in (1, 2):
        counts = Counter(p[i] for p in pieces if p[i] is not None)
        # what occurs once conflicts with nothing and needs no bit
        bits.append({x: 1 << j for j, x in enumerate(x for x, n in counts.items() if n > 1)})
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        s, c = bits[0].get(source, 0), bits[1].get(cluster, 0)
        i = bisect_left(order, (length, 0))
        while i < len(order) and (sources[order[i][1]] & s or clusters[order[i][1]] & c):
            i += 1
        if i < len(order):
            residual, chosen = order.pop(i)
            sources[chosen] |= s
            clusters[chosen] |= c
        else:
            residual, chosen = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        insort(order, (residual - length, chosen))
        out.append((chosen, capacity - residual))
    return out


def pieces(documents: DataFrame, capacity: int, text: str, doc_id: str, source: str, cluster: Column) -> DataFrame:
    """(doc_id, piece, start, length, source, cluster, text): whole texts in pieces of ``capacity`` or less."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.alias("cluster"), whole.alias("text"), F.length(whole).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * capacity
    part = F.when(F.col("n") <= capacity, F.col("text")).otherwise(F.substr("text", start + 1, F.lit(capacity)))
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("length"), "source", "cluster", part.alias("text"))


def pack(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, text: str = "text", doc_id: str = "doc_id", source: str = "source", cluster: Column | None = None, with_text: bool = False) -> DataFrame:
    """One row per piece: bin, offset (its place in the bin), doc_id, piece, start, length, and text if asked for.

    ``cluster``: any column that is equal for duplicates; default: the hash of the text, so that exact
    copies are in conflict, and null for null texts. The number of shards follows from the number of pieces, so their mean size is that of ``shard``.
    """
    n = F.greatest(F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / capacity), F.lit(1))
    total = documents.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard))
    cluster = F.when(F.col(text).isNotNull(), F.xxhash64(text)) if cluster is None else cluster.cast("long")
    rows = pieces(documents, capacity, text, doc_id, source, cluster)
    rows = rows if with_text else rows.drop("text")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    names = ["bin", "offset", *rows.columns]
    schema = dealt.selectExpr("shard AS bin", "length AS offset", *rows.columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, table in _chunks(batches, 2 * shard):
            placed = best_fit(list(zip(*(table[c].to_pylist() for c in ("length", "source", "cluster")), strict=True)), capacity)
            # shard, chunk and bin in one number: below 2^20 chunks of below 2^20 bins
            bins = pa.array([(number << 40) + (chunk << 20) + b for b, _ in placed], pa.int64())
            offsets = pa.array([o for _, o in placed], pa.int32())
            made = pa.table([bins, offsets, *(table[c] for c in rows_names)], names=names)
            yield from made.combine_chunks().to_batches()

    rows_names = rows.columns
    return dealt.mapInArrow(run, schema).drop("cluster")


def _chunks(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[tuple[int, int, pa.Table]]:
    """(shard, number of the chunk in it, its rows). Rows come sorted by shard."""
    held: list[pa.RecordBatch] = []
    current, rows, chunk = None, 0, 0
    for batch in batches:
        at = 0
        for number, run in groupby(batch.column("shard").to_pylist()):
            n = sum(1 for _ in run)
            if number != current:
                if rows:
                    yield current, chunk, pa.Table.from_batches(held)
                held, rows, chunk, current = [], 0, 0, number
            while n:
                take = min(n, bound - rows)
                held.append(batch.slice(at, take))
                at, n, rows = at + take, n - take, rows + take
                if rows == bound:
                    yield current, chunk, pa.Table.from_batches(held)
                    held, rows, chunk = [], 0, chunk + 1
    if rows:
        yield current, chunk, pa.Table.from_batches(held)
