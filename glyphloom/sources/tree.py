"""Source trees on a mounted file system.

Spark's own file sources skip every name that starts with "_" or ".", which would lose
``__init__.py``. Here executors list a tree in rounds, without reading it: a task opens a bounded
number of folders and hands on those it has not opened, which the next round deals out to all tasks
again. So a large branch, however deep it begins, is listed by everybody, and the driver holds
nothing but a count for each round. Contents are read in a second step, by executors, for the files
that are wanted.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import split_patterns
from ..operators.filters import indexable_files
from ..schema import IGNORED_DIRS, MAX_FILE_BYTES
from .scratch import scratch_folder

#: Folders that a task opens in the first round, and at most in later ones. Each round opens more.
FIRST_FOLDERS, MOST_FOLDERS = 256, 65_536
_ROWS = 10_000
_BATCH_BYTES = 32 << 20
_LISTED = "file_path string, mtime double, size long, folder boolean"


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """Entries of a folder, as they come and without symbolic links."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                if not e.is_symlink():
                    yield e
    except OSError:
        return


def _opened(
    folders: Iterator[str], root: str, ignored: set[str], limit: int
) -> Iterator[tuple[str, float | None, int | None, bool]]:
    """Files below ``folders``, and the folders that are left to open after ``limit`` of them."""
    for given in folders:
        if limit <= 0:
            yield given, None, None, True
            continue
        waiting = deque([given])
        while waiting:
            folder = waiting.popleft()
            limit -= 1
            for entry in _entries(os.path.join(root, folder)):
                path = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    path.encode("utf-8")
                    if entry.name not in ignored and not entry.name.startswith(".") and entry.is_dir():
                        if len(waiting) < limit:
                            waiting.append(path)
                        else:
                            yield path, None, None, True
                    elif entry.is_file():
                        stat = entry.stat()
                        yield path, stat.st_mtime, stat.st_size, False
                except (OSError, UnicodeEncodeError):
                    continue


def _files_below(spark: SparkSession, root: str, ignored: set[str]) -> DataFrame:
    """(file_path, mtime, size) of all files, written round by round and read again."""
    place, slots = scratch_folder(spark), spark.sparkContext.defaultParallelism
    folders, waiting, limit, rounds = spark.createDataFrame([("",)], "file_path string"), 1, FIRST_FOLDERS, []

    def visitor(limit: int):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = (path for batch in batches for path in batch.column("file_path").to_pylist())
            held: list[tuple] = []
            for row in _opened(given, root, ignored, limit):
                held.append(row)
                if len(held) == _ROWS:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

        return visit

    while waiting:
        seen, target = Observation(), f"{place}/round-{len(rounds)}"
        dealt = folders.repartition(min(waiting, 4 * slots), "file_path").mapInArrow(visitor(limit), _LISTED)
        dealt.observe(seen, F.count_if("folder").alias("waiting")).write.parquet(target)
        waiting = seen.get["waiting"]
        rounds.append(target)
        folders = spark.read.schema(_LISTED).parquet(target).where("folder").select("file_path")
        limit = min(2 * limit, MOST_FOLDERS)
    return spark.read.schema(_LISTED).parquet(*rounds).where(~F.col("folder")).drop("folder")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.bool_()]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["file_path", "mtime", "size", "folder"])


def mounted_path(root: str) -> str:
    """The path of a folder given as a path or file: URI; other file systems are refused."""
    path = root.removeprefix("file:")
    if re.match(r"\w+:", path):
        raise ValueError(f"not on a mounted file system: {root}")
    return re.sub(r"^/{2,}", "/", path)


def _local(root: str) -> str:
    path = os.path.realpath(mounted_path(root))
    if not os.path.isdir(path):
        raise NotADirectoryError(f"not a directory: {root}")
    return path


def list_tree(
    spark: SparkSession,
    root: str,
    languages: Iterable[str] | None = None,
    ignore_patterns: Iterable[str] | None = None,
    ignore_dirs: Iterable[str] | None = None,
    extensions: Mapping[str, str] | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """(file_path, mtime, size, language) of the indexable files below ``root``, unread.

    Symbolic links are not followed, unreadable folders hold nothing, ignored and hidden
    folders are never entered. ``root`` must be mounted at the same place everywhere. The tree
    is listed once, when this is called; the listing is kept with the intermediate tables.
    """
    patterns = list(ignore_patterns or ())
    names = set(IGNORED_DIRS if ignore_dirs is None else ignore_dirs)
    names |= split_patterns(patterns)[0]
    files = _files_below(spark, _local(root), names)
    return indexable_files(files, languages, patterns, ignore_dirs, extensions, max_bytes)


def read_tree(files: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """Add the bytes of listed files; null where a file can no longer be read.

    Listed rows are tiny and reading is not, so they are first spread over a fixed number
    of partitions, which adaptive execution does not merge again.
    """
    base = _local(root)
    count = partitions or 4 * files.sparkSession.sparkContext.defaultParallelism

    def load(path: str) -> bytes | None:
        try:
            with open(os.path.join(base, path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, contents = 0, 0, []
            for n, path in enumerate(batch.column("file_path").to_pylist(), start=1):
                contents.append(load(path))
                held += len(contents[-1] or b"")
                if held > _BATCH_BYTES or n == batch.num_rows:
                    part = batch.slice(first, n - first)
                    column = pa.array(contents, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, column], names=[*part.schema.names, "content"]
                    )
                    first, held, contents = n, 0, []

    schema = T.StructType(files.schema.fields + [T.StructField("content", T.BinaryType())])
    return files.repartition(count, "file_path").mapInArrow(rows, schema)


def scan_tree(spark: SparkSession, root: str, **filters) -> DataFrame:
    """List and read: (file_path, mtime, size, language, content BINARY)."""
    return read_tree(list_tree(spark, root, **filters), root)
