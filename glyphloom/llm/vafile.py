"""Exact top-k by inner product with a vector-approximation file.

Vectors of whole numbers are stored with their cells: each dimension's range is cut into
2^``bits`` equal cells, one byte per dimension. For a query q and a cell with lower corner l and
widths w, the inner product with any vector in the cell lies between q.l + sum min(q w', 0) and
q.l + sum max(q w', 0), w' being the largest offset inside a cell; one product of matrices gives
both bounds for all pairs. Exact vectors are then read in order of their bounds, best first, until
the k-th exact score leaves no bound above it.

Queries go out in blocks of bounded size, each broadcast to a scan of the stored file; vectors are
never shuffled. Each task keeps k rows per query. A start value for the k-th score, from a bounded
sample of vectors, lets most tasks return nothing for most queries; it speeds the search up and
leaves its result as it is. Scores of a task's queries cover all vectors of its partition.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
empty ones or rows without a vec_id (as in SQL, where null differs from no query's vec_id); a query meets vectors of its own length only; rows with the query's own vec_id are left
out; repeated rows each take a rank; of several query rows with one vec_id the smallest vector
counts; fewer candidates than k are returned as they are; components beyond 2^25 in size are held
at that bound, so that all scores are exact in 64 bits (up to 2^13 dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder

BITS = 6
#: Components of a block of queries that is broadcast (8 bytes each), and pairs scored at a time.
QUERY_CELLS = 1 << 21
PAIRS = 1 << 22
#: Vectors that give each query its start value.
SAMPLE = 2_048
LIMIT = 1 << 25
LOWEST = -(1 << 62)  # below any score, and with room to change its sign


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x; vectors that take no part are gone."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    held = lambda c: F.greatest(F.least(F.floor(c * float(scale)), F.lit(LIMIT)), F.lit(-LIMIT))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(fine)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def grids(vectors: DataFrame, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: the lower end of each dimension and the width of its cells (whole numbers)."""
    cells = vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x"))
    # one row per length and dimension, however many vectors
    rows = cells.groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in rows}:
        own = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["at"])
        low = np.array([r["low"] for r in own], np.int64)
        found[dim] = low, (np.array([r["high"] for r in own], np.int64) - low >> bits) + 1
    return found


def write_file(vectors: DataFrame, folder: str, bits: int = BITS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Store (vec_id, dim, cells, v) below ``folder``; returns the grids."""
    grid = grids(vectors, bits)
    shared = vectors.sparkSession.sparkContext.broadcast(grid)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id"), batch.column("v")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                own = lists.take(rows)
                v = own.flatten().to_numpy().reshape(-1, dim)
                low, width = shared.value[int(dim)]
                cells = ((v - low) // width).astype(np.uint8)
                packed = pa.array([c.tobytes() for c in cells], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(np.full(len(rows), dim, np.int32)), packed, own], names=["vec_id", "dim", "cells", "v"])

    vectors.mapInArrow(approximate, "vec_id long, dim int, cells binary, v array<long>").write.parquet(folder)
    return grid


class Search:
    """The best k of each query so far, over the batches of one partition."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, start: np.ndarray, grid: tuple[np.ndarray, np.ndarray], k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.low, self.width = grid
        self.scores = np.full((len(ids), k), LOWEST)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = start.copy()  # scores below this cannot be among the best k
        offset = queries * (self.width - 1)
        self.above = np.maximum(offset, 0).sum(1).astype(np.float64)
        self.below = np.minimum(offset, 0).sum(1).astype(np.float64)

    def add(self, ids: np.ndarray, cells: np.ndarray, exact) -> None:
        """``exact(rows)``: the exact vectors at those places of the batch."""
        corners = (cells * self.width + self.low).astype(np.float64)
        step = max(1, PAIRS // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            self._add(slice(at, at + step), ids, corners, exact)

    def _add(self, part: slice, ids: np.ndarray, corners: np.ndarray, exact) -> None:
        queries = self.queries[part]
        corner = queries.astype(np.float64) @ corners.T  # exact: whole numbers below 2^53, or bounds with room
        room = np.abs(corner).max(initial=0) * 1e-12
        own = ids[None, :] == self.ids[part][:, None]
        lower = np.where(own, -np.inf, corner + self.below[part, None] - room)
        if lower.shape[1] > self.k:
            kth = np.partition(lower, lower.shape[1] - self.k, axis=1)[:, -self.k]
            usable = np.isfinite(kth)
            self.least[part][usable] = np.maximum(self.least[part][usable], np.floor(kth[usable]).astype(np.int64))
        upper = np.where(own, -np.inf, corner + self.above[part, None] + room)
        q, row = np.nonzero(upper >= self.least[part][:, None])
        # best bounds first; a block of pairs is read, then what can no longer win is dropped
        order = np.lexsort((-upper[q, row], q))
        q, row = q[order], row[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q, "left")
        done = 0
        while len(q):
            now = turn < done + 4 * self.k
            self._read(part.start, q[now], row[now], queries, ids, exact)
            done += 4 * self.k
            left = ~now
            q, row, turn = q[left], row[left], turn[left]
            open_ = upper[q, row] >= self.least[part][q]
            q, row, turn = q[open_], row[open_], turn[open_]
            if len(q):
                # the rest of a query closes up, so that each turn reads its next best bounds
                turn = np.arange(len(q)) - np.searchsorted(q, q, "left") + done

    def _read(self, base: int, q: np.ndarray, row: np.ndarray, queries: np.ndarray, ids: np.ndarray, exact) -> None:
        if not len(q):
            return
        needed, at = np.unique(row, return_inverse=True)
        vectors = exact(needed)
        score = np.empty(len(q), np.int64)
        for i in range(0, len(q), 1 << 16):
            score[i : i + (1 << 16)] = np.einsum("ij,ij->i", queries[q[i : i + (1 << 16)]], vectors[at[i : i + (1 << 16)]])
        touched = np.unique(q)
        all_q = np.concatenate((np.repeat(touched, self.k), q))
        all_s = np.concatenate((self.scores[base + touched].ravel(), score))
        all_i = np.concatenate((self.best[base + touched].ravel(), ids[row]))
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        first = np.searchsorted(all_q, touched, "left")
        take = first[:, None] + np.arange(self.k)
        self.scores[base + touched], self.best[base + touched] = all_s[take], all_i[take]
        self.least[base + touched] = np.maximum(self.least[base + touched], all_s[take][:, -1])

    def found(self) -> Iterator[pa.RecordBatch]:
        q, place = np.nonzero(self.best != np.iinfo(np.int64).max)
        keep = self.scores[q, place] >= self.least[q]
        q, place = q[keep], place[keep]
        columns = [self.ids[q], self.best[q, place], self.scores[q, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scan(stored: DataFrame, shared, k: int, out: str = "query_id long, vec_id long, score long") -> DataFrame:
    """The best k per partition of every query in the broadcast (dim -> ids, vectors, start values, grid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: Search(*given, k) for dim, given in shared.value.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()) & searches.keys():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                cells = np.frombuffer(b"".join(own.column("cells").to_pylist()), np.uint8).reshape(-1, dim).astype(np.int64)
                lists = own.column("v")
                searches[dim].add(own.column("vec_id").to_numpy(), cells, lambda rows, lists=lists, dim=dim: _matrix(lists.take(pa.array(rows)), dim))
        for search in searches.values():
            yield from search.found()

    return stored.select("vec_id", "dim", "cells", "v").mapInArrow(run, out)


def _start(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that k sampled vectors reach for each query, so that no lower one can be among its best k."""
    least = np.full(len(ids), LOWEST)
    for at in range(0, len(ids) if len(sample) > k else 0, 1024):
        part = slice(at, at + 1024)
        score = queries[part].astype(np.float64) @ sample.T.astype(np.float64)
        score[sample_ids[None, :] == ids[part][:, None]] = -np.inf
        kth = np.partition(score, len(sample) - k, axis=1)[:, -k]
        usable = np.isfinite(kth)
        least[part][usable] = np.floor(kth[usable] - np.abs(kth[usable]) * 1e-12).astype(np.int64)
    return least


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = BITS, folder: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to the smaller vec_id.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    folder = folder or scratch_folder(spark)
    given = whole_vectors(vectors, vec_id, embedding)
    grid = write_file(given, f"{folder}/cells", bits)
    stored = spark.read.parquet(f"{folder}/cells")
    asked = stored.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked.withColumn("dim", F.size("v")).write.parquet(f"{folder}/queries")
    asked = spark.read.parquet(f"{folder}/queries")
    total = asked.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // QUERY_CELLS))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    sample = stored.select("dim", "vec_id", "v").limit(SAMPLE).toArrow() if total else None
    found = None
    for i in range(n if total else 0):
        block = asked.where(part == i).toArrow()  # about QUERY_CELLS components
        blocks = {}
        for dim in set(block.column("dim").to_pylist()):
            mine, near = ({c: t.filter(pa.compute.equal(t.column("dim"), dim)).column(c).combine_chunks() for c in ("vec_id", "v")} for t in (block, sample))
            ids, queries = mine["vec_id"].to_numpy(), _matrix(mine["v"], dim)
            blocks[dim] = ids, queries, _start(ids, queries, near["vec_id"].to_numpy(), _matrix(near["v"], dim), k), grid[dim]
        scan(stored, spark.sparkContext.broadcast(blocks), k).write.parquet(f"{folder}/found/block={i}")
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(*(f"{folder}/found/block={i}" for i in range(n)))
    # rows per query: at most k for each partition, and few of them pass the start value
    best = found.groupBy("query_id", "vec_id", "score").agg(F.count("*").alias("times"))
    best = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))).alias("copy"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
