"""Search and look-up on a stored index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import present
from ..operators.changes import broadcast_within, join_bytes
from ..operators.changes import list_snippets as in_order
from ..operators.embed import Embedder, embed, embedder_named
from ..operators.search import top_k as search_top_k
from ..schema import TOP_K
from ..sources.index import SnippetIndex
from ..sources.scratch import scratch_folder

_POINT_LOOKUPS = 1000


def search(index: SnippetIndex, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Top-k ids for query vectors (query_id, embedding): (query_id, rank, id, score)."""
    return search_top_k(index.vectors(), queries, top_k)


def find(
    index: SnippetIndex,
    queries: str | Iterable[str] | DataFrame,
    top_k: int = TOP_K,
    embedder: Embedder | None = None,
) -> DataFrame:
    """The best snippets for query texts, with ``header`` and ``preview``.

    ``queries`` is a text, several texts (numbered from 0) or a frame (query_id, text).
    """
    most = None
    if not isinstance(queries, DataFrame):
        texts = [queries] if isinstance(queries, str) else list(queries)
        rows, most = list(enumerate(texts)), top_k * len(texts)
        queries = index.spark.createDataFrame(rows, "query_id long, text string")
    model = embedder or embedder_named(index.meta["model_name"])
    hits = search(index, embed(queries, "text", model), top_k)
    return present.format_hits(_with_snippets(index, hits, most))


def _with_snippets(index: SnippetIndex, hits: DataFrame, most: int | None = None) -> DataFrame:
    """Join snippets to hits. ``most``: how many there can be, if that is known.

    A few hits are read to the driver, and their ids go to the reader. Others are written down first
    and measured. Hits within the bound for broadcasts leave the snippets where they are. Where there are few,
    their ids also go to the reader, which tests them against bloom filters before it opens any
    content column. Many more meet the snippets by a shuffle of ids and hits.
    """
    if most is not None and most <= _POINT_LOOKUPS:
        rows = hits.collect()
        ids = sorted({r["id"] for r in rows})
        hits = F.broadcast(index.spark.createDataFrame(rows, hits.schema))
        return present.hydrate(hits, index.snippets().where(F.col("id").isin(ids)))
    folder = f"{scratch_folder(index.spark)}/hits"
    hits.write.parquet(folder)
    hits = index.spark.read.schema(hits.schema).parquet(folder)
    snippets = index.snippets()
    found = hits.agg(F.count("*").alias("n"), join_bytes(F.col("id")).alias("size")).first()
    if found["n"] <= _POINT_LOOKUPS:
        ids = sorted({r["id"] for r in hits.select("id").collect()})
        snippets = snippets.where(F.col("id").isin(ids))
    return present.hydrate(broadcast_within(hits, found["size"]), snippets)


def show(index: SnippetIndex, snippet: str) -> DataFrame:
    return present.show(index.snippets(), snippet)


def list_snippets(index: SnippetIndex) -> DataFrame:
    return in_order(index.snippets())


def count_snippets(index: SnippetIndex) -> DataFrame:
    return index.snippets().agg(F.count("*").alias("snippets"))
