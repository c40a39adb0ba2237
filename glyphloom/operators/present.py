"""Hits joined back to their snippets and rendered as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hit_header, label, preview


def hydrate(hits: DataFrame, snippets: DataFrame) -> DataFrame:
    """Hits with their snippets; a hit without one drops out, ranks stay."""
    return hits.join(snippets, "id", "inner")


def format_hits(hydrated: DataFrame) -> DataFrame:
    """Add ``header`` and ``preview`` to hydrated hits."""
    header = hit_header(
        *(F.col(c) for c in ["rank", "score", "kind", "name", "file_path", "start_line", "id"])
    )
    return hydrated.withColumns({"header": header, "preview": preview(F.col("content"))})


def show(snippets: DataFrame, snippet: str) -> DataFrame:
    """The snippet of an id with ``title`` and ``subtitle``, or no row.

    The equality reaches the parquet scan.
    """
    place = F.format_string("%s:%d-%d  id=%s", "file_path", "start_line", "end_line", "id")
    found = snippets.where(F.col("id") == snippet)
    return found.withColumns({"title": label(F.col("kind"), F.col("name")), "subtitle": place})
