"""Exact cosine top-k for batches of queries.

Vectors are never paired with queries row by row. Each Arrow batch of vectors is one matrix
product with a block of queries. A task keeps its best k rows per query from batch to batch and
hands them on once, so what is shuffled for the final ranking is at most k rows per query and
partition.

* Query sets up to ``broadcast_bytes`` are read once and broadcast; the vectors stay where
  they are and are scanned once.
* Larger sets are never brought to the driver: they are written once, so that queries are
  embedded once, and queries and vectors are hashed into blocks of bounded size, of which each
  (query block, vector block) cell is one cogrouped task.

Scores rank by their value rounded to 6 digits, then by id, so that the result does not
depend on how rows were batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TOP_K
from ..sources.scratch import scratch_folder

BROADCAST_BYTES = 128 << 20
CELL_BYTES = 64 << 20
_SCALE = 1_000_000  # scores are ranked on this many steps per unit
_MAX_SCORES = 4 << 20  # scores held at once per task


def check_dimension(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row (vectors, dimension); raises when a vector is null or widths differ."""
    width = F.size(column)
    totals = vectors.agg(
        F.count("*").alias("vectors"),
        F.count(column).alias("present"),
        F.min(width).alias("narrow"),
        F.max(width).alias("wide"),
    )
    message = F.concat(
        F.lit("vectors must be present and of one width: "),
        F.to_json(F.struct("vectors", "present", "narrow", "wide")),
    )
    consistent = (F.col("vectors") == 0) | (
        (F.col("vectors") == F.col("present")) & (F.col("narrow") == F.col("wide"))
    )
    dimension = F.when(consistent, F.coalesce("wide", F.lit(0))).otherwise(
        F.raise_error(message).cast("int")
    )
    return totals.select("vectors", dimension.alias("dimension"))


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(n, dim) float64 matrix of unit rows; zero rows stay zero."""
    column = _flat(column)
    if column.null_count:
        raise ValueError("a vector is null")
    widths = pc.unique(pc.list_value_length(column))
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths.to_pylist()}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = rows.reshape(len(column), widths[0].as_py() if len(widths) else 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _best(query_ids: pa.Array, queries: np.ndarray, ids: pa.Array, vectors: np.ndarray, k: int):
    """Yield record batches of each query's k best rows among ``vectors``."""
    if len(vectors) == 0 or len(queries) == 0:
        return
    if vectors.shape[1] != queries.shape[1]:
        raise ValueError(f"queries have width {queries.shape[1]}, vectors {vectors.shape[1]}")
    position = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)
    step = max(1, _MAX_SCORES // len(vectors))
    for first in range(0, len(queries), step):
        scores = queries[first : first + step] @ vectors.T
        steps = np.rint(scores * _SCALE).astype(np.int64)
        order = steps * (len(vectors) + 1) - position  # unique: score first, then id
        keep = min(k, len(vectors))
        chosen = np.argpartition(-order, keep - 1, axis=1)[:, :keep]
        owners = np.repeat(np.arange(first, first + len(scores)), keep)
        yield pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(owners)),
                ids.take(pa.array(chosen.ravel())),
                pa.array(np.take_along_axis(scores, chosen, axis=1).ravel()),
                pa.array(np.take_along_axis(steps, chosen, axis=1).ravel()),
            ],
            names=["query_id", "id", "score", "steps"],
        )


def _best_of(found: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k best rows per query of several batches."""
    table = pa.Table.from_batches(found)
    table = table.sort_by([("query_id", "ascending"), ("steps", "descending"), ("id", "ascending")])
    owner = _flat(table["query_id"]).dictionary_encode().indices.to_numpy()
    first = np.searchsorted(owner, owner, "left")  # codes ascend as the rows are sorted
    return table.filter(pa.array(np.arange(len(owner)) - first < k)).combine_chunks().to_batches()


def _scan(vectors: DataFrame, held: pa.Table, k: int, schema: T.StructType) -> DataFrame:
    """Local winners of every vector batch against the broadcast queries."""
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(
        (_flat(held["query_id"]), _unit_rows(held["embedding"]))
    )

    def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        held: list[pa.RecordBatch] = []
        rows, bound = 0, 4 * k * max(len(query_ids), 1)
        for batch in batches:
            if batch.num_rows:
                ids, unit = batch.column("id"), _unit_rows(batch.column("embedding"))
                for found in _best(query_ids, queries, ids, unit, k):
                    held.append(found)
                    rows += found.num_rows
                if rows > bound:
                    held = _best_of(held, k)
                    rows = sum(x.num_rows for x in held)
        if held:
            yield from _best_of(held, k)

    return vectors.mapInArrow(winners, schema)


def _cells(
    vectors: DataFrame, queries: DataFrame, k: int, schema: T.StructType, bytes_per_block: int
) -> DataFrame:
    """Local winners of every (query block, vector block) cell.

    Vectors are the larger side and travel once per query block, so these are kept few.
    """

    def blocks(df: DataFrame, block_bytes: int) -> int:
        return max(1, ceil(_matrix_bytes(df) / block_bytes))

    n_queries, n_vectors = blocks(queries, 4 * bytes_per_block), blocks(vectors, bytes_per_block)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("*", every(n_queries).alias("qb"), block("id", n_vectors).alias("vb"))
    right = queries.select("*", block("query_id", n_queries).alias("qb"), every(n_vectors).alias("vb"))

    def winners(vector_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        found = _best(
            _flat(query_rows["query_id"]),
            _unit_rows(query_rows["embedding"]),
            _flat(vector_rows["id"]),
            _unit_rows(vector_rows["embedding"]),
            k,
        )
        names = ["query_id", "id", "score", "steps"]
        kinds = [query_rows.schema.field("query_id").type, vector_rows.schema.field("id").type]
        fields = zip(names, [*kinds, pa.float64(), pa.int64()])
        return pa.Table.from_batches(list(found), schema=pa.schema(list(fields)))

    by = ["qb", "vb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(winners, schema)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """The k most similar ``vectors`` (id, embedding) of each query (query_id, embedding).

    Returns (query_id, rank, id, score); fewer than k rows where there are fewer vectors,
    none for k <= 0.
    """
    kinds = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", kinds[0]),
            T.StructField("id", kinds[1]),
            T.StructField("score", T.DoubleType()),
            T.StructField("steps", T.LongType()),
        ]
    )
    vectors, queries = vectors.select("id", "embedding"), queries.select("query_id", "embedding")
    if k <= 0:
        scored = vectors.sparkSession.createDataFrame([], schema)
    else:
        held = queries.limit(FEW_QUERIES + 1).toArrow()
        if held.num_rows > FEW_QUERIES or held.nbytes > broadcast_bytes:
            # written once: embedding queries may be costly, and they are measured before they are read
            folder = f"{scratch_folder(queries.sparkSession)}/queries"
            queries.write.parquet(folder)
            queries = queries.sparkSession.read.schema(queries.schema).parquet(folder)
            held = _read_bounded(queries, broadcast_bytes)
        if held is None:
            scored = _cells(vectors, queries, k, schema, cell_bytes)
        else:
            scored = _scan(vectors, held, k, schema)
    return rank_hits(scored).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


#: Queries up to this number go to the driver straight away.
FEW_QUERIES = 1_000


def _matrix_bytes(df: DataFrame) -> int:
    """Bytes the vectors of a frame take as a float64 matrix with their keys."""
    return df.agg(F.sum(F.size("embedding").cast("long") * 8 + 64)).first()[0] or 0


def _read_bounded(queries: DataFrame, max_bytes: int) -> pa.Table | None:
    """The queries as one Arrow table, or None when they take more than ``max_bytes``."""
    return queries.toArrow() if _matrix_bytes(queries) <= max_bytes else None


def rank_hits(scored: DataFrame) -> DataFrame:
    """Number the hits of each query from 1: higher score first, then smaller id."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc("steps"), "id")
    return scored.withColumn("rank", F.row_number().over(best_first))
