"""File filters: which rows of a ``files`` frame are worth indexing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import IGNORED_DIRS, MAX_FILE_BYTES


def filter_extensions(
    files: DataFrame, extensions: Mapping[str, str] | None = None
) -> DataFrame:
    """Keep files with a registered suffix and add their ``language``."""
    tagged = files.withColumn("language", paths.language_for(F.col("file_path"), extensions))
    return tagged.where(F.col("language").isNotNull())


def filter_languages(
    files: DataFrame,
    languages: Iterable[str] | None,
    extensions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keep files of the given languages; None keeps every registered one, [] none."""
    tagged = filter_extensions(files, extensions)
    return tagged if languages is None else tagged.where(F.col("language").isin(sorted(set(languages))))


def filter_ignored_dirs(files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Drop files below an ignored or hidden directory (hidden *files* stay)."""
    return files.where(~paths.in_ignored_dir(F.col("file_path"), names))


def filter_ignore_patterns(
    files: DataFrame, patterns: Iterable[str] | None, ignore_dirs: Iterable[str] | None = None
) -> DataFrame:
    """Apply "name/" patterns with the ignored directories, other patterns as globs."""
    return files.where(~_ignored(F.col("file_path"), patterns, ignore_dirs))


def _ignored(path: Column, patterns: Iterable[str] | None, ignore_dirs: Iterable[str] | None) -> Column:
    extra, globs = paths.split_patterns(patterns or ())
    names = set(IGNORED_DIRS if ignore_dirs is None else ignore_dirs) | extra
    return paths.in_ignored_dir(path, names) | paths.matches_any_glob(path, globs)


def passes_path(
    path: Column,
    languages: Iterable[str] | None = None,
    ignore_patterns: Iterable[str] | None = None,
    ignore_dirs: Iterable[str] | None = None,
    extensions: Mapping[str, str] | None = None,
) -> Column:
    """What ``indexable_files`` asks of a path, as one condition."""
    language = paths.language_for(path, extensions)
    wanted = language.isNotNull() if languages is None else language.isin(sorted(set(languages)))
    return F.coalesce(wanted & ~_ignored(path, ignore_patterns, ignore_dirs), F.lit(False))


def filter_size(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Drop files larger than ``max_bytes``; without a size the content's length counts, if there is one."""
    size = F.col("size")
    if "content" in files.columns:
        size = F.coalesce(size, F.octet_length("content").cast("long"))
    return files.where(F.coalesce(size <= max_bytes, F.lit(True)))


def indexable_files(
    files: DataFrame,
    languages: Iterable[str] | None = None,
    ignore_patterns: Iterable[str] | None = None,
    ignore_dirs: Iterable[str] | None = None,
    extensions: Mapping[str, str] | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """All filters at once; every one is a narrow predicate on path or size."""
    kept = filter_languages(files, languages, extensions)
    return filter_size(filter_ignore_patterns(kept, ignore_patterns, ignore_dirs), max_bytes)
