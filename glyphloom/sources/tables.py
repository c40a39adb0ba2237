"""Files held in a table: the usual form of a large code corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import relative_path
from ..functions.text import content_hash, decode_text


def files_from_table(
    table: DataFrame,
    path: str = "file_path",
    content: str = "content",
    mtime: str = "mtime",
    size: str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Canonical ``files`` frame (file_path, content, mtime, size) of a table.

    Give ``size`` when the table stores it: listings then never touch the content column.
    Give ``root`` when paths are absolute: they become relative to it, so that folders above it
    are not taken for ignored ones.
    """
    length = F.octet_length(F.col(content)) if size is None else F.col(size)
    return table.select(
        relative_path(F.col(path), root).alias("file_path"),
        F.col(content).alias("content"),
        F.col(mtime).cast("double").alias("mtime"),
        length.cast("long").alias("size"),
    )


#: Bytes of a table per core below which ``spread_scan`` shuffles it.
_SMALL_BYTES = 16 << 20


def spread_scan(table: DataFrame) -> DataFrame:
    """Spread the scan of a small table over all cores.

    Extraction costs far more than a shuffle of the text, so a small table in one row group
    should not keep one core busy and the others idle. Large tables are left as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return table.repartition(cores) if size < cores * _SMALL_BYTES else table


def decode_files(files: DataFrame) -> DataFrame:
    """``content`` as text; rows that are binary or could not be read drop out.

    The text comes out of a generator, through which no filter is pushed down: what reads the content
    is then evaluated once, also where it is a user's function.
    """
    raw = F.col("content")
    if isinstance(files.schema["content"].dataType, T.BinaryType):
        text = decode_text(raw)
    else:
        text = F.when(~F.contains(raw, F.lit("\x00")), raw)
    decoded = F.filter(F.array(text), lambda t: t.isNotNull())
    others = [c for c in files.columns if c != "content"]
    return files.select(*others, F.explode(decoded).alias("content")).select(*files.columns)


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``content_hash`` of decoded files."""
    return files.withColumn("content_hash", content_hash(F.col("content")))
