"""Blank-line block splitting.

Everything about one file is decided inside that file's own row, with array functions
over its lines, so splitting needs no shuffle and no sort: scan, project, explode.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAKS, has_text, let, snippet_id, split_lines
from ..schema import ID_LENGTH, MAX_BLOCK_LINES, MIN_BLOCK_LINES


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"))


def block_islands(lines: Column) -> Column:
    """Maximal runs of non-blank lines as array<struct<first,last>> (0-based, inclusive)."""
    filled = F.array_compact(
        F.transform(lines, lambda s, i: F.when(has_text(s), i))
    )

    def runs(at: Column) -> Column:
        opens = F.filter(at, lambda i, n: F.coalesce(F.get(at, n - 1) < i - 1, F.lit(True)))
        closes = F.filter(at, lambda i, n: F.coalesce(F.get(at, n + 1) > i + 1, F.lit(True)))
        return F.zip_with(opens, closes, _span)

    return let(filled, runs)


def merge_blocks(spans: Column, min_lines: int = MIN_BLOCK_LINES) -> Column:
    """Join blocks under ``min_lines`` to the next one, trailing ones to the previous.

    A group ends at each block that is large enough; whatever follows the last such block
    still belongs to its group. Only a block's own size counts.
    """
    big = lambda b: b["last"] - b["first"] + 1 >= min_lines

    def groups(b: Column, last_big: Column) -> Column:
        heads = F.filter(
            b, lambda x, n: (n == 0) | ((n <= last_big) & F.coalesce(big(F.get(b, n - 1)), F.lit(False)))
        )
        tails = F.filter(b, lambda x, n: (n == F.size(b) - 1) | ((n < last_big) & big(x)))
        return F.zip_with(heads, tails, lambda h, t: _span(h["first"], t["last"]))

    def grouped(b: Column) -> Column:
        last = F.coalesce(
            F.array_max(F.transform(b, lambda x, n: F.when(big(x), n))), F.lit(-1)
        )
        return let(last, lambda last_big: groups(b, last_big))

    return let(spans, grouped)


def chunk_blocks(spans: Column, max_lines: int = MAX_BLOCK_LINES) -> Column:
    """Cut spans into consecutive pieces of at most ``max_lines`` lines."""

    def pieces(b: Column) -> Column:
        return F.transform(
            F.sequence(b["first"], b["last"], F.lit(max_lines)),
            lambda p: _span(p, F.least(p + (max_lines - 1), b["last"])),
        )

    return F.flatten(F.transform(spans, pieces))


def blocks_of(
    text: Column,
    max_lines: int = MAX_BLOCK_LINES,
    min_lines: int = MIN_BLOCK_LINES,
    breaks: str = LINE_BREAKS,
) -> Column:
    """Blocks of a text as array<struct<start_line,end_line,content>> (1-based lines)."""

    def cut(lines: Column) -> Column:
        spans = chunk_blocks(merge_blocks(block_islands(lines), min_lines), max_lines)
        return F.transform(
            spans,
            lambda b: F.struct(
                (b["first"] + 1).alias("start_line"),
                (b["last"] + 1).alias("end_line"),
                F.array_join(
                    F.slice(lines, b["first"] + 1, b["last"] - b["first"] + 1), "\n"
                ).alias("content"),
            ),
        )

    return let(split_lines(text, breaks), cut)


def blocks_of_column(name: str, max_lines: int, min_lines: int, breaks: str) -> Column:
    """``blocks_of`` a named column; the unresolved expression is large and built once per session.

    Columns are handles into the JVM and of no use in another one.
    """
    return _built(SparkContext._active_spark_context, name, max_lines, min_lines, breaks)


@lru_cache(maxsize=32)
def _built(context: SparkContext, name: str, max_lines: int, min_lines: int, breaks: str) -> Column:
    return blocks_of(F.col(name), max_lines, min_lines, breaks)


def split_blocks(
    files: DataFrame,
    max_lines: int = MAX_BLOCK_LINES,
    min_lines: int = MIN_BLOCK_LINES,
    breaks: str = LINE_BREAKS,
    id_length: int = ID_LENGTH,
) -> DataFrame:
    """One ``block`` snippet per block of every (file_path, language, content) row.

    Files without a ``language`` column are ``generic``.
    """
    if "language" not in files.columns:
        files = files.withColumn("language", F.lit("generic"))
    blocks = files.select(
        "file_path",
        "language",
        F.posexplode(blocks_of_column("content", max_lines, min_lines, breaks)).alias(
            "ordinal", "b"
        ),
    )
    return blocks.select(
        snippet_id(
            F.col("file_path"),
            F.col("b.start_line"),
            F.col("b.end_line"),
            F.col("b.content"),
            length=id_length,
        ).alias("id"),
        "file_path",
        "b.start_line",
        "b.end_line",
        F.lit("block").alias("kind"),
        F.lit(None).cast("string").alias("name"),
        "language",
        "b.content",
        "ordinal",
    )
