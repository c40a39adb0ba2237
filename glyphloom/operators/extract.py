"""Files -> snippets: declarations first, everything they leave over as blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAKS, NEWLINES, has_text, snippet_id
from ..schema import ID_LENGTH, MAX_BLOCK_LINES, MIN_BLOCK_LINES
from .blocks import blocks_of_column
from .declarations import parse_declarations


def _as_snippets(rows: Column, kind: Column | None = None) -> Column:
    """Same struct layout for declaration and block arrays."""
    return F.transform(
        rows,
        lambda r: F.struct(
            r["start_line"].alias("start_line"),
            r["end_line"].alias("end_line"),
            (r["kind"] if kind is None else kind).alias("kind"),
            (r["name"] if kind is None else F.lit(None).cast("string")).alias("name"),
            r["content"].alias("content"),
        ),
    )


def _explode(files: DataFrame, snippets: Column, id_length: int, carry: Iterable[str] = ()) -> DataFrame:
    """One row per snippet. ``carry``: columns of the file to put beside its first snippet only.

    With them a file without snippets has one row, without an id.
    """
    names = list(carry)
    numbered = (F.posexplode_outer if names else F.posexplode)(snippets).alias("ordinal", "s")
    rows = files.select("file_path", "language", *names, numbered)
    first = F.coalesce(F.col("ordinal"), F.lit(0)) == 0
    there = F.col("ordinal").isNotNull()
    made = snippet_id(
        F.col("file_path"),
        F.col("s.start_line"),
        F.col("s.end_line"),
        F.col("s.content"),
        length=id_length,
    )
    return rows.select(
        (F.when(there, made) if names else made).alias("id"),
        "file_path",
        "s.start_line",
        "s.end_line",
        "s.kind",
        "s.name",
        "language",
        "s.content",
        "ordinal",
        *(F.when(first, F.col(c)).alias(c) for c in names),
    )


def _parsed(files: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    return files.select(
        "file_path",
        "language",
        "content",
        *carry,
        parse_declarations(F.col("language"), F.col("content")).alias("parsed"),
    )


def extract_declarations(files: DataFrame, id_length: int = ID_LENGTH) -> DataFrame:
    """Functions, classes and methods only."""
    return _explode(_parsed(files), _as_snippets(F.col("parsed.declarations")), id_length)


def extract_python(files: DataFrame, id_length: int = ID_LENGTH) -> DataFrame:
    return extract_declarations(files.where(F.col("language") == "python"), id_length)


def extract_braces(files: DataFrame, id_length: int = ID_LENGTH) -> DataFrame:
    braces = F.col("language").isin("javascript", "typescript", "dart")
    return extract_declarations(files.where(braces), id_length)


def leftovers(
    files: DataFrame,
    max_lines: int = MAX_BLOCK_LINES,
    min_lines: int = MIN_BLOCK_LINES,
    id_length: int = ID_LENGTH,
) -> DataFrame:
    """Blocks of what the declarations of parsed files do not cover."""
    rest = blocks_of_column("parsed.leftover", max_lines, min_lines, NEWLINES)
    return _explode(_parsed(files), _as_snippets(rest, F.lit("block")), id_length)


def extract_snippets(
    files: DataFrame,
    max_lines: int = MAX_BLOCK_LINES,
    min_lines: int = MIN_BLOCK_LINES,
    id_length: int = ID_LENGTH,
    keep_blank: bool = True,
    carry: Iterable[str] = (),
) -> DataFrame:
    """All snippets of every (file_path, language, content) row, in one narrow pass.

    Python and brace languages: declarations, then blocks of the rest. Other languages
    and Python that does not parse: blocks. ``ordinal`` breaks ties of ``start_line``.
    ``carry`` names columns of the file to put beside its first snippet; a file without snippets
    then has one row, without an id. ``keep_blank=False`` drops pieces that hold no text at all, which arise where a long
    merged range is cut inside covered lines.
    """
    whole = blocks_of_column("content", max_lines, min_lines, LINE_BREAKS)
    rest = blocks_of_column("parsed.leftover", max_lines, min_lines, NEWLINES)
    block = F.lit("block")
    snippets = F.when(
        F.col("parsed").isNotNull(),
        F.concat(_as_snippets(F.col("parsed.declarations")), _as_snippets(rest, block)),
    ).otherwise(_as_snippets(whole, block))
    rows = _explode(_parsed(files, carry), snippets, id_length, carry)
    return rows if keep_blank else rows.where(has_text(F.col("content")))


def order_in_file(snippets: DataFrame) -> DataFrame:
    """Reading order: declarations before leftovers, a class before its methods."""
    return snippets.orderBy("file_path", "start_line", "ordinal")
