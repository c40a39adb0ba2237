"""Declarations of source files: Python by its grammar, JS/TS/Dart by shape and braces.

Finding a declaration depends on where the previous one ended, so it is sequential inside
one file and independent between files: one Arrow UDF over (language, content) columns,
fed only with files of these languages. It returns its rows in pieces, so that a worker holds
the declarations of a bounded amount of text, whatever the size of the batches. Hashing, block splitting and exploding stay in
Spark expressions (see ``extract``).
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PARSED_LANGUAGES = ("python", "javascript", "typescript", "dart")

_DECLARATION = pa.struct(
    [
        pa.field("start_line", pa.int32()),
        pa.field("end_line", pa.int32()),
        pa.field("kind", pa.string()),
        pa.field("name", pa.string()),
        pa.field("content", pa.string()),
    ]
)
_PARSED = pa.struct(
    [pa.field("declarations", pa.list_(_DECLARATION)), pa.field("leftover", pa.string())]
)
_DECLARATIONS_DDL = "array<struct<start_line:int,end_line:int,kind:string,name:string,content:string>>"
_PARSED_DDL = f"declarations {_DECLARATIONS_DDL}, leftover string"

#: Characters of text after which the rows made so far leave the worker.
PIECE_CHARS = 1 << 20

# Names that are control flow rather than declarations, and how declarations begin,
# always at a line start. What follows up to the opening brace is looked up, see _Ahead.
CONTROL_WORDS = frozenset(["if", "for", "while", "switch", "catch", "do", "else", "try", "with", "function"])
NAME = r"[A-Za-z_$][\w$]*"
JS_CLASS = rf"^[ \t]*(?:export\s+)?(?:default\s+)?class\s+(?P<name>{NAME})"
JS_FUNCTION = (
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*+\*?+\s*+"
    rf"(?P<name>{NAME})?+\s*+\("
)
JS_ARROW = rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*(?=[:=])"
# Modifiers may stand on lines of their own, and the last one is a name if a parenthesis follows. Where
# no name with a parenthesis follows, ``head`` ends behind them: no line before it can begin a method.
JS_METHOD = (
    r"^[ \t]*+(?P<head>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s++(?!\())++)?+"
    rf"(?:(?P<name>{NAME})(?P<opened>\s*+\()?|(?(head)|(?!)))"
)
DART_CLASS = rf"^[ \t]*(?:abstract\s+)?class\s+(?P<name>{NAME})"

# A Dart callable is "type run, name, (parameters), optional async/sync marker, brace".
# The run may span lines, so it is looked up from its parenthesis instead of being tried
# anew at each line: every character is visited a bounded number of times.
_DART_RUN = re.compile(r"[\w$<>,\[\]?\s]++(\()?")
_DART_NAME = re.compile(rf"\s({NAME})\s*\Z")
_DART_STOP = re.compile(r"[;{]")
_DART_CLOSE = re.compile(r"\)\s*+(?:a?sync\s*+\*?)?\s*+\Z")

# Plain text up to and including the next brace, string or comment.
_NEXT_TOKEN = re.compile(
    r"""[^{}'"`/]*+ (?:
      (?P<brace>[{}])
    | (?P<triple>'''|\"""|```) (?:[^\\'"`]|\\.|(?!(?P=triple)).)*+ (?:(?P=triple))?
    | '(?:[^'\\\n]|\\.)*+'?
    | "(?:[^"\\\n]|\\.)*+"?
    | `(?:[^`\\]|\\.)*+`?
    | //[^\n]*+
    | /\*(?:.*?\*/|.*)
    | / | \Z )""",
    re.VERBOSE | re.DOTALL,
)
_NEWLINE = re.compile(r"\r\n|[\n\r]")
_COVERED = re.compile(r"(?:[^\r\n]|\r(?=\n))+")

Hit = tuple[int, int, str | None]  # start of the match, its opening brace, declared name
Finder = Callable[[str, int, int], Hit | None]


class _Braces:
    """Closing braces of a text, ignoring strings and comments.

    A scan from one brace passes others on its way; it notes their partners too, so that a brace
    that has been passed is never scanned from again.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.partner: dict[int, int | None] = {}

    def closing(self, opening: int) -> int | None:
        if opening not in self.partner:
            open_: list[int] = []
            for token in _NEXT_TOKEN.finditer(self.text, opening):
                if not token["brace"]:
                    continue
                at = token.end() - 1
                if token["brace"] == "{":
                    open_.append(at)
                    continue
                self.partner[open_.pop()] = at
                if not open_:
                    break
            self.partner.update(dict.fromkeys(open_))
        return self.partner[opening]


def closing_brace(text: str, opening: int) -> int | None:
    """Index of the brace closing ``text[opening]``, ignoring strings and comments."""
    return _Braces(text).closing(opening)


class _Ahead:
    """The next place of some characters, for places asked in ascending order: one pass in all."""

    def __init__(self, text: str, characters: str) -> None:
        self.find = re.compile(f"[{re.escape(characters)}]").search
        self.text, self.asked, self.found = text, -1, -1

    def __call__(self, at: int) -> int:
        """Index of the first of the characters at or after ``at``; the text's length if none."""
        if not self.asked <= at <= self.found:
            m = self.find(self.text, at)
            self.asked, self.found = at, m.start() if m else len(self.text)
        return self.found


class _Behind:
    """End of what a pattern matches at a place; many declarations may ask about the same place."""

    def __init__(self, pattern: str, text: str) -> None:
        self.match, self.text = re.compile(pattern).match, text
        self.known: dict[tuple[int, int], int | None] = {}

    def __call__(self, at: int, end: int) -> int | None:
        if (at, end) not in self.known:
            m = self.match(self.text, at, end)
            self.known[at, end] = m.end() if m else None
        return self.known[at, end]


def _spaces(covered: re.Match[str]) -> str:
    return " " * len(covered.group())


def _blanked(text: str) -> str:
    """``text`` with a space for every character that is not part of a line break."""
    if "\r" in text:
        return _COVERED.sub(_spaces, text)
    return "\n".join([" " * len(line) for line in text.split("\n")])


def _lines(text: str) -> list[str]:
    return _NEWLINE.split(text) if "\r" in text else text.split("\n")


def _line_ends(text: str) -> list[int]:
    """Where each line begins but the first."""
    if "\r" in text:
        return [m.end() for m in _NEWLINE.finditer(text)]
    return list(accumulate(len(line) + 1 for line in text.split("\n")))[:-1]


_SPACE = r"\s*+"
_ARROW_VALUE = r"=\s*+(?:async\s*+)?\("
Tail = Callable[[str, int, int], int | None]  # text, end of the head, bound -> opening brace


def _shape(head: str, tail: Callable[[str], Tail]) -> Callable[[str], Finder]:
    """Finder of a head at a line start whose tail leads to a brace."""
    compiled = re.compile(head, re.MULTILINE)
    runs = "head" in compiled.groupindex

    def of(source: str) -> Finder:
        opening = tail(source)

        def find(text: str, start: int, end: int) -> Hit | None:
            at = start
            while m := compiled.search(text, at, end):
                whole = not runs or m["opened"] is not None
                brace = opening(text, m.end(), end) if whole else None
                if brace is not None and brace < end:
                    return m.start(), brace, m["name"]
                at = max(m.start() + 1, m.end("head")) if runs else m.start() + 1
            return None

        return find

    return of


def _until_brace(stop: str = "{") -> Callable[[str], Tail]:
    """Anything up to a brace, unless another stop comes first."""

    def tail(source: str) -> Tail:
        ahead = _Ahead(source, stop)

        def opening(text: str, at: int, end: int) -> int | None:
            found = ahead(at)
            return found if found < end and text[found] == "{" else None

        return opening

    return tail


def _after_parameters(source: str) -> Tail:
    """Parameters up to the next parenthesis, perhaps a type after a colon, a brace."""
    parenthesis, brace, space = _Ahead(source, ")"), _Ahead(source, "{"), _Behind(_SPACE, source)

    def opening(text: str, at: int, end: int) -> int | None:
        closed = parenthesis(at)
        if closed >= end:
            return None
        at = space(closed + 1, end)
        if text[at : at + 1] == ":":
            found = brace(at + 1)
            return found if found > at + 1 else None
        return at if text[at : at + 1] == "{" else None

    return opening


def _arrow(source: str) -> Tail:
    """Perhaps a type, an equals sign, parameters, perhaps a type, an arrow, a brace."""
    equals, parenthesis = _Ahead(source, "="), _Ahead(source, ")")
    space, opened = _Behind(_SPACE, source), _Behind(_ARROW_VALUE, source)

    def past_type(text: str, at: int, end: int) -> int | None:
        """From a colon to the next equals sign, with something between."""
        if text[at : at + 1] != ":":
            return at
        found = equals(at + 1)
        return found if at + 1 < found < end else None

    def opening(text: str, at: int, end: int) -> int | None:
        at = past_type(text, at, end)
        value = opened(at, end) if at is not None else None
        closed = parenthesis(value) if value else end
        if closed >= end:
            return None
        at = past_type(text, space(closed + 1, end), end)
        if at is None or text[at : at + 2] != "=>":
            return None
        at = space(at + 2, end)
        return at if text[at : at + 1] == "{" else None

    return opening


def _dart_callable(text: str, start: int, end: int) -> Hit | None:
    stop = closing = -1
    for run in _DART_RUN.finditer(text, start, end):
        if run[1] is None:
            continue
        paren = run.end() - 1
        if paren > stop:
            found = _DART_STOP.search(text, paren, end)
            if found is None:
                return None
            stop, closing = found.start(), -1
            if found.group() == "{":
                closed = _DART_CLOSE.search(text, paren, stop)
                closing = closed.start() if closed else -1
        named = _DART_NAME.search(run.group(), 0, len(run.group()) - 1)
        if closing <= paren or named is None:
            continue
        line = 0 if run.start() == 0 else run.group().find("\n") + 1
        if (run.start() == 0 or line > 0) and named.start() > line:
            return run.start() + line, stop, named[1]
    return None


def _dart(source: str) -> Finder:
    return _dart_callable


_JS = (
    (
        ("class", _shape(JS_CLASS, _until_brace())),
        ("function", _shape(JS_FUNCTION, _after_parameters)),
        ("function", _shape(JS_ARROW, _arrow)),
    ),
    (("method", _shape(JS_METHOD, _after_parameters)),),
)
_SHAPES = {
    "javascript": _JS,
    "typescript": _JS,
    "dart": (
        (("class", _shape(DART_CLASS, _until_brace("{;"))), ("function", _dart)),
        (("method", _dart),),
    ),
}


def _declared(
    text: str, start: int, end: int, shapes: tuple[tuple[str, Finder], ...], braces: _Braces
) -> Iterator[tuple[str, str, int, int, int]]:
    """(kind, name, start, brace, close) of the declarations in text[start:end], in order.

    A shape's next hit stays valid until the scan has moved past it, so each shape is
    searched once per hit rather than once per declaration of any shape.
    """
    upcoming: dict[int, Hit | None] = {}
    at = start
    while at < end:
        for i, (_, find) in enumerate(shapes):
            if i not in upcoming or (upcoming[i] is not None and upcoming[i][0] < at):
                upcoming[i] = find(text, at, end)
        ahead = [(hit[0], i) for i, hit in upcoming.items() if hit is not None]
        if not ahead:
            return
        first, i = min(ahead)
        _, brace, name = upcoming[i]
        close = None
        if name is not None and name not in CONTROL_WORDS:
            close = braces.closing(brace)
        if close is None or close > end:
            at = brace + 1
            continue
        yield shapes[i][0], name, first, brace, close
        at = close + 1


def parse_braces(text: str, language: str) -> tuple[list[dict], str]:
    """Declarations of a JS, TS or Dart file, and the text with them blanked out."""
    shapes = _SHAPES[language]
    top, member = ([(kind, make(text)) for kind, make in level] for level in shapes)
    braces = _Braces(text)
    line_ends = _line_ends(text)

    def row(kind: str, name: str, first: int, close: int) -> dict:
        return {
            "start_line": bisect_right(line_ends, first) + 1,
            "end_line": bisect_right(line_ends, close) + 1,
            "kind": kind,
            "name": name,
            "content": text[first : close + 1],
        }

    rows, rest, kept = [], [], 0
    for kind, name, first, brace, close in _declared(text, 0, len(text), top, braces):
        rows.append(row(kind, name, first, close))
        if kind == "class":
            for _, method, m_first, _, m_close in _declared(text, brace + 1, close, member, braces):
                rows.append(row("method", f"{name}.{method}", m_first, m_close))
        rest += [text[kept:first], _blanked(text[first : close + 1])]
        kept = close + 1
    return rows, "".join(rest) + text[kept:]


def parse_python(text: str) -> tuple[list[dict], str] | None:
    """Functions, classes and methods of a Python file and the text without their lines.

    None when the text does not parse; the caller then splits it into blocks.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = _lines(text)
    if lines[-1] == "":
        lines.pop()
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def row(node: ast.stmt, kind: str, name: str) -> dict:
        first = min(n.lineno for n in [node, *node.decorator_list])
        return {
            "start_line": first,
            "end_line": node.end_lineno,
            "kind": kind,
            "name": name,
            "content": "\n".join(lines[first - 1 : node.end_lineno]),
        }

    rows, rest = [], list(lines)
    for node in module.body:
        if not isinstance(node, (*functions, ast.ClassDef)):
            continue
        whole = row(node, "class" if isinstance(node, ast.ClassDef) else "function", node.name)
        rows.append(whole)
        covered = range(whole["start_line"] - 1, whole["end_line"])
        rest[covered.start : covered.stop] = [""] * len(covered)
        if isinstance(node, ast.ClassDef):
            rows += [
                row(n, "method", f"{node.name}.{n.name}")
                for n in node.body
                if isinstance(n, functions)
            ]
    return rows, "\n".join(rest)


def _parse(language: str | None, text: str | None) -> dict | None:
    if text is None or language not in PARSED_LANGUAGES:
        return None
    parsed = parse_python(text) if language == "python" else parse_braces(text, language)
    return parsed and {"declarations": parsed[0], "leftover": parsed[1]}


def _parsed_pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The rows of each batch in pieces of about ``PIECE_CHARS`` characters of text."""
    for languages, texts in batches:
        made, held = [], 0
        for language, text in zip(languages, texts):
            text = text.as_py()
            made.append(_parse(language.as_py(), text))
            held += len(text or "")
            if held >= PIECE_CHARS:
                yield pa.array(made, _PARSED)
                made, held = [], 0
        yield pa.array(made, _PARSED)


def parse_declarations(language: Column, content: Column) -> Column:
    """struct<declarations, leftover>; null for other languages and unparseable Python.

    A text without a brace declares nothing in the brace languages: it does not travel to Python and back.
    """
    parse = F.arrow_udf(_parsed_pieces, _PARSED_DDL)
    plain = language.isin(*_SHAPES) & ~F.contains(content, F.lit("{"))
    nothing = F.array().cast(_DECLARATIONS_DDL).alias("declarations")
    parsed = parse(language, F.when(language.isin(*PARSED_LANGUAGES) & ~plain, content))
    return F.when(plain, F.struct(nothing, content.alias("leftover"))).otherwise(parsed)
