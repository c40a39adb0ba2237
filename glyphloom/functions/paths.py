"""Path column expressions: languages, ignored directories and ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTENSIONS, IGNORED_DIRS


def relative_path(path: Column, root: str | None = None) -> Column:
    """Path below ``root``, without ``.`` segments and doubled slashes.

    Paths that do not lie below ``root`` are only tidied.
    """
    tidy = F.regexp_replace(path, r"/(?:\./|/)*", "/")
    tidy = F.regexp_replace(tidy, r"^\./|/\.\z", "")
    if root is None:
        return tidy
    base = re.sub(r"/(?:\./|/)*", "/", root + "/").removeprefix("./")
    below = tidy.startswith(base)
    return F.when(below, F.substr(tidy, F.lit(len(base) + 1))).otherwise(tidy) if base != "/" else F.ltrim(tidy, F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last ".ext" of the file name, or "" (a leading or a trailing dot opens none)."""
    return F.regexp_extract(basename(path), r"(?s).(\.[^.]+)\z", 1)


def language_for(path: Column, extensions: Mapping[str, str] | None = None) -> Column:
    """Language registered for the suffix; null when there is none."""
    table = EXTENSIONS if extensions is None else extensions
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def in_ignored_dir(path: Column, names: Iterable[str] | None = None) -> Column:
    """True when a directory above the file is ignored by name or starts with a dot."""
    ignored = sorted(IGNORED_DIRS if names is None else names)
    parents = F.split(path, "/")
    parents = F.slice(parents, 1, F.size(parents) - 1)
    return F.exists(parents, lambda d: d.startswith(".") | d.isin(ignored))


def split_patterns(patterns: Iterable[str]) -> tuple[set[str], list[str]]:
    """Separate "name/" directory patterns from globs on files."""
    patterns = list(patterns)
    dirs = {p.rstrip("/") for p in patterns if p.endswith("/")}
    return dirs, [p for p in patterns if not p.endswith("/")]


def glob_to_regex(pattern: str) -> str:
    """Anchored Java regex of a shell glob: ``*`` (also over "/"), ``?``, ``[seq]``, ``[!seq]``."""

    def piece(m: re.Match[str]) -> str:
        token = m.group()
        if token[0] == "*":
            return ".*"
        if token == "?":
            return "."
        members = token[1:-1].removeprefix("!")
        if members:
            return _char_class(members, token[1] == "!")
        return re.sub(r"\W", r"\\\g<0>", token) if token.isascii() else token

    body = re.sub(r"\*+|\?|\[!?\]?[^\]]*\]|.", piece, pattern, flags=re.DOTALL)
    return rf"(?s)\A(?:{body})\z"


def _char_class(members: str, negated: bool) -> str:
    """Java character class; ranges that run backwards hold nothing."""
    escape = lambda c: "\\" + c if re.fullmatch(r"[\[\]\\^&\-~|]", c) else c
    parts = []
    i = 0
    while i < len(members):
        if i + 2 < len(members) and members[i + 1] == "-":
            low, high = members[i], members[i + 2]
            if low <= high:
                parts.append(f"{escape(low)}-{escape(high)}")
            i += 3
        else:
            parts.append(escape(members[i]))
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def matches_any_glob(path: Column, globs: Iterable[str]) -> Column:
    """True when a glob matches the whole relative path or the bare file name."""
    regexes = [glob_to_regex(g) for g in globs]
    if not regexes:
        return F.lit(False)
    union = "|".join(regexes)
    return path.rlike(union) | basename(path).rlike(union)
