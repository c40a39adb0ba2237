"""Text column expressions: decoding, lines, hashes, ids and display strings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ID_LENGTH

# Fixed values (Java regex): every line boundary of Unicode text, the plain newline forms
# source-code parsers count, and "holds a character that is not white space".
LINE_BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
NEWLINES = r"\r\n|[\n\r]"
_SPACE = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NOT_BLANK = f"[^{_SPACE}]"
# The line boundaries other than \\n. Each is looked for by its bytes, which together is several times
# faster than one regex over all characters.
_OTHER_BREAKS = {
    LINE_BREAKS: ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"),
    NEWLINES: ("\r",),
}
TRAILING_SPACE = rf"[{_SPACE}]+\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A plain alias would be inlined by the optimizer at every use, and inside another
    lambda even once per element; a lambda variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_text(raw: Column) -> Column:
    """BINARY -> STRING: null when a NUL byte occurs; UTF-8 (BOM dropped), else Latin-1."""
    text = raw.cast("string")
    bom = F.lit("﻿")
    utf8 = F.when(text.startswith(bom), F.substr(text, F.lit(2))).otherwise(text)
    return F.when(
        ~F.contains(raw, F.lit(bytearray(b"\x00"))),
        F.when(F.is_valid_utf8(text), utf8).otherwise(F.decode(raw, "ISO-8859-1")),
    )


def has_text(line: Column) -> Column:
    """Whether a string holds a character that is not white space.

    Plain spaces in front go first: a blanked-out line can be long, and the regex would try each of them.
    Most lines then begin with a visible ASCII character, which a comparison of bytes tells without the regex.
    """
    begun = F.ltrim(line)
    return begun.between("!", "~") | begun.rlike(NOT_BLANK)


def split_lines(text: Column, breaks: str = LINE_BREAKS) -> Column:
    """Array of lines; a final line break opens no further line, "" has no lines.

    Splitting on one character is several times faster than on a regex of all the breaks,
    which only texts with unusual breaks need.
    """
    parts = lambda t: F.when(
        reduce(or_, [F.contains(t, F.lit(c)) for c in _OTHER_BREAKS[breaks]]), F.split(t, breaks, -1)
    ).otherwise(F.split(t, "\n", -1))
    return let(
        let(text, parts),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def content_hash(text: Column) -> Column:
    """sha256 (hex) of the decoded text."""
    return F.sha2(text, 256)


def snippet_id(
    file_path: Column,
    start_line: Column,
    end_line: Column,
    content: Column,
    explicit: Column | None = None,
    length: int = ID_LENGTH,
) -> Column:
    """Leading hex digits of sha256("path:start:end:content"); a non-empty explicit id wins.

    12 digits are 48 bits: corpora beyond some millions of snippets want ``length=64``.
    """
    key = F.concat_ws(":", file_path, start_line.cast("string"), end_line.cast("string"), content)
    computed = F.substring(F.sha2(key, 256), 1, length)
    return computed if explicit is None else F.when(explicit != "", explicit).otherwise(computed)


def line_count(start_line: Column, end_line: Column) -> Column:
    return end_line - start_line + 1


def location(file_path: Column, start_line: Column) -> Column:
    return F.concat_ws(":", file_path, start_line.cast("string"))


def embedding_text(language: Column, name: Column, content: Column) -> Column:
    """What an embedder sees: language line, name line (when there is a name), content."""
    named = F.when(name != "", F.concat(F.lit("# "), name))
    return F.concat_ws("\n", F.concat(F.lit("# "), language), named, content)


def label(kind: Column, name: Column) -> Column:
    return F.when(name.isNull(), kind).otherwise(F.concat_ws(" ", kind, name))


def thousandths(x: Column) -> Column:
    """``x`` rounded to 3 digits by its binary value, ties to even, as printf in C and Python.

    Spark's own rounding looks at the shortest decimal form, in which 1.0005 is a tie though its
    value lies below. ``x`` is split into two whole numbers of 32 bits, which holds it exactly
    wherever it could be a tie.
    """
    scaled = F.abs(x) * float(1 << 32)
    high = F.floor(scaled)
    low = F.floor((scaled - high) * float(1 << 32))
    whole = lambda c: c.cast("long").cast("decimal(20,0)")
    unit = F.lit(str(1 << 64)).cast("decimal(20,0)")
    n = (whole(high) * F.lit(1 << 32).cast("decimal(10,0)") + whole(low)) * F.lit(1000).cast("decimal(4,0)")
    floor = F.floor(n / unit).cast("decimal(20,0)")
    # the division above is rounded itself: the remainder tells by how much it is off
    rest = n - floor * unit
    floor = floor + F.when(rest < 0, -1).when(rest >= unit, 1).otherwise(0).cast("decimal(20,0)")
    rest = (n - floor * unit) * F.lit(2).cast("decimal(1,0)")
    up = (rest > unit) | ((rest == unit) & (floor % 2 == 1))
    return F.signum(x) * (floor + up.cast("int").cast("decimal(1,0)")).cast("double") / 1000.0


def hit_header(
    rank: Column,
    score: Column,
    kind: Column,
    name: Column,
    file_path: Column,
    start_line: Column,
    snippet: Column,
) -> Column:
    """``rank. [score] label  (path:line)  id=...`` with the score half-even to 3 digits."""
    return F.format_string(
        "%d. [%.3f] %s  (%s)  id=%s",
        rank,
        thousandths(score),
        label(kind, name),
        location(file_path, start_line),
        snippet,
    )


def preview(content: Column, max_lines: int = 3, max_chars: int = 200) -> Column:
    """The first lines, indented; cut and marked when longer than ``max_chars``."""
    indented = F.transform(
        F.slice(split_lines(content), 1, max_lines), lambda s: F.concat(F.lit("    "), s)
    )
    return let(
        F.array_join(indented, "\n"),
        lambda t: F.when(
            F.char_length(t) > max_chars,
            F.concat(
                F.regexp_replace(F.substring(t, 1, max_chars), TRAILING_SPACE, ""), F.lit(" ...")
            ),
        ).otherwise(t),
    )
