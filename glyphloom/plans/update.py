"""Incremental update of a stored index.

Phase 1 compares paths and mtimes only and writes down what differs. Phase 2 reads just those
files, once, and keeps their texts and hashes; from these it writes the file log of the new
generation. From there on the classification is fixed, whatever is recomputed later. Phase 3
extracts and embeds the kept texts of new and changed files. The commit makes all of it
visible at once.

What phase 2 costs: phase 1 notes the data file that each path was listed from, and the scan of
contents opens those data files only (up to ``DATA_FILES`` of them). Within them it skips row groups
outside the range of paths and mtimes that differ, and where at most ``PATH_LITERALS`` paths do, the
paths themselves go to the reader. Changes in every data file of a table without order read all of
its contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import (
    broadcast_within,
    compare_files,
    file_status,
    join_bytes,
    newest_per_key,
    same_mtime,
    update_summary,
)
from ..operators.embed import Embedder, embedder_named
from ..schema import CHANGED, FILE_LOG, NEW, REMOVED, SKIPPED
from ..sources import folders
from ..sources.index import COMPRESSION, SnippetIndex, compact_index, open_index
from ..sources.tables import decode_files, hash_files
from .build import IndexChange, IndexOptions, Reader

PATH_LITERALS = 500
#: Data files whose names are given to the listing of a scan.
DATA_FILES = 10_000

_ORDERED = ["file_path", "mtime"]
_TEXTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["file_path", "language", "content", "content_hash"]]
)


def _embedder_of(index: SnippetIndex, embedder: Embedder | None) -> Embedder:
    stored = index.meta["model_name"]
    if embedder is None:
        return embedder_named(stored)
    if embedder.name != stored:
        raise ValueError(f"the index holds vectors of {stored!r}, not of {embedder.name!r}")
    return embedder


def update_index(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    embedder: Embedder | None = None,
    options: IndexOptions = IndexOptions(),
    read_content: Reader | None = None,
) -> IndexChange:
    """Bring the index at ``path`` up to date with ``files``, all files there now are.

    Paths of ``files`` are unique. A file no longer present, or no longer let through by
    the filters, is removed. Without ``embedder`` the stored model is used.
    """
    index = open_index(spark, path)
    embedder = _embedder_of(index, embedder)
    kept = options.keep(files)
    listed = kept.select("file_path", "language", "mtime", *located(kept))
    both = compare_files(listed, index.manifest())
    differs = both.where(~same_mtime())
    return _apply(index, differs, kept, read_content, embedder, options, index.meta)


def located(files: DataFrame) -> list[Column]:
    """The data file of each row, where the rows come straight from a table of data files."""
    if "_metadata" in files.columns:
        return []
    hidden = files._jdf.queryExecution().analyzed().metadataOutput()
    names = {hidden.apply(i).name() for i in range(hidden.size())}
    return [F.col("_metadata.file_path").alias("data_file")] if "_metadata" in names else []


def in_data_files(files: DataFrame, of: DataFrame) -> DataFrame:
    """``files`` from the data files of ``of`` alone; the others are not opened.

    All of them where ``of`` does not know its data files or names more than ``DATA_FILES``.
    """
    place = located(files)
    if not place or "data_file" not in of.columns:
        return files
    rows = of.select("data_file").distinct().limit(DATA_FILES + 1).collect()
    if len(rows) > DATA_FILES or any(r[0] is None for r in rows):
        return files
    return files.where(F.col("_metadata.file_path").isin([r[0] for r in rows]))


def apply_changes(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    embedder: Embedder | None = None,
    options: IndexOptions = IndexOptions(),
    marks: dict[str, str] | None = None,
) -> IndexChange:
    """Apply rows (file_path, content, mtime, size, deleted) about single files.

    A null ``deleted`` is false. Of several rows of a path the one with the latest mtime counts,
    and of equal mtimes a deletion; a deletion without mtime counts as later than all others of
    its batch, any other row without one as earlier. The same rule holds against what the index
    knows, so the order of batches does not matter where rows have mtimes: rows older than the
    known state, or than a deletion on record, change nothing. Files not mentioned stay as they
    are; a known file whose newest row the filters no longer let through is removed. ``marks``
    are added to the stored meta values.
    """
    index = open_index(spark, path)
    embedder = _embedder_of(index, embedder)
    folder = index.staging()
    deleted = F.coalesce("deleted", F.lit(False))
    # contents that no row of this path can bring into the index need not be shuffled
    usable = options.takes_path(F.col("file_path")) & ~deleted
    rows = changes.withColumns({"deleted": deleted, "content": F.when(usable, F.col("content"))})
    rows = rows.withColumn("usable", usable).withColumn("turn", _turn())
    newest_per_key(rows, "file_path", "turn").drop("turn").write.option("compression", COMPRESSION).parquet(folder)
    newest = spark.read.parquet(folder)
    size = newest.agg(join_bytes(F.col("file_path"))).first()[0]
    touched, buckets = broadcast_within(newest.select("file_path"), size), index.buckets_of(newest)
    only = lambda known: known.join(touched, "file_path", "left_semi")
    # at most one row for each path of the batch: with it broadcast, the contents are not shuffled once more
    before = only(index.removals(buckets)).select("file_path", F.col("mtime").alias("removed_mtime"))
    newest = newest.join(broadcast_within(before, size), "file_path", "left").where(
        F.coalesce(F.col("mtime") > F.col("removed_mtime"), F.lit(True))
    )
    kept = options.keep(newest.where("usable"))
    times = newest.select("file_path", F.col("mtime").alias("row_mtime"))
    listed = kept.select("file_path", "language", "mtime")
    both = compare_files(listed, only(index.manifest(buckets))).join(times, "file_path")
    late = F.coalesce(F.col("row_mtime") < F.col("known_mtime"), F.lit(False))
    differs = both.where((F.col("present") | F.col("known")) & ~same_mtime() & ~late)
    # a removal is put on record under the time of its row, or the last one known: older rows come too late
    time = F.when(F.col("present"), F.col("row_mtime")).otherwise(F.coalesce("row_mtime", "known_mtime"))
    differs = differs.withColumn("mtime", time).drop("row_mtime")
    unknown = newest.where("deleted").join(both.where("known"), "file_path", "left_anti")
    gone = unknown.select("file_path", "mtime").withColumns({"present": F.lit(False), "known": F.lit(False)})
    differs = differs.unionByName(gone, allowMissingColumns=True)
    meta = {**index.meta, **(marks or {})}
    change = _apply(index, differs, kept, None, embedder, options, meta)
    folders.remove(spark, folder)
    return change


def _turn():
    """What orders the rows of one path: mtime, then deletions last, then the content."""
    time = F.coalesce("mtime", F.when(F.col("deleted"), float("inf")).otherwise(float("-inf")))
    return F.struct(time, F.col("deleted"), F.xxhash64("content"))


def _apply(
    index: SnippetIndex,
    differs: DataFrame,
    kept: DataFrame,
    read_content: Reader | None,
    embedder: Embedder,
    options: IndexOptions,
    meta: dict[str, str],
) -> IndexChange:
    spark, generation, staging = index.spark, index.new_generation(), index.staging()
    differs.write.parquet(f"{staging}/files")
    staged = spark.read.schema(differs.schema).parquet(f"{staging}/files")
    present = F.col("present")
    found = staged.agg(
        join_bytes(F.col("file_path")).alias("size"),
        F.count_if(present).alias("present"),
        F.count_if(present & F.col("mtime").isNull()).alias("untimed"),
        *[F.min(F.when(present, F.col(c))).alias(f"low_{c}") for c in _ORDERED],
        *[F.max(F.when(present, F.col(c))).alias(f"high_{c}") for c in _ORDERED],
    ).first()

    wanted = staged.where(present).select("file_path", "language", "mtime")
    if read_content is not None:
        contents = read_content(wanted)
    else:
        kept = in_data_files(kept, staged.where(present))
        # lets the scan skip row groups, whole ones when only the latest changed
        for c in _ORDERED if not found["untimed"] else _ORDERED[:1]:
            kept = kept.where(F.col(c).between(F.lit(found[f"low_{c}"]), F.lit(found[f"high_{c}"])))
        if found["present"] <= PATH_LITERALS:  # a filter on top: the join below decides
            kept = kept.where(F.col("file_path").isin([r[0] for r in wanted.select("file_path").collect()]))
        wanted = broadcast_within(wanted.select("file_path"), found["size"])
        contents = kept.join(wanted, "file_path", "left_semi")
    texts = hash_files(decode_files(contents)).select(*_TEXTS.names)
    # few rows out of many input partitions: even them out before they become files
    texts.hint("rebalance").write.option("compression", COMPRESSION).parquet(f"{staging}/texts")
    texts = spark.read.schema(_TEXTS).parquet(f"{staging}/texts")

    log = staged.join(texts.select("file_path", "content_hash"), "file_path", "left").withColumn("status", file_status())
    log.write.parquet(f"{staging}/log")
    log = spark.read.schema(log.schema).parquet(f"{staging}/log")
    changed = log.where(F.col("status").isin(NEW, CHANGED)).select("file_path")
    changed = texts.join(broadcast_within(changed, found["size"]), "file_path", "left_semi")
    _, width = index.write_snippets(generation, options.snippets(changed, embedder))

    empty = F.array().cast(FILE_LOG["places"].dataType)
    fresh = F.when(F.col("status").isin(NEW, CHANGED, REMOVED), F.coalesce("places", empty))
    placed = broadcast_within(index.written(generation), found["size"])
    index.write_files(generation, log.join(placed, "file_path", "left").withColumn("places", fresh))
    replaced = log.where(F.col("status").isin(CHANGED, REMOVED) & F.col("known")).select("file_path")
    deleted = index.write_deletions(generation, broadcast_within(replaced, found["size"]))

    counts = log.groupBy("status", "known").count().collect()
    tally = {(r["status"], r["known"]): r["count"] for r in counts}
    added, changes = tally.get((NEW, False), 0), tally.get((CHANGED, True), 0)
    removed, skipped = tally.get((REMOVED, True), 0), tally.get((SKIPPED, True), 0)
    updated = index.commit(
        generations=(*index.generations, generation),
        files=index.files + added - removed,
        logged=index.logged + sum(tally.values()),
        logged_bytes=index.logged_bytes + found["size"],
        deleted_bytes=index.deleted_bytes + deleted,
        width=width,
        meta=meta,
    )
    folders.remove(spark, staging)
    log = updated.file_log(generation)
    unchanged = F.lit(index.files - changes - removed - skipped).cast("long")
    summary = update_summary(log.where((F.col("status") != REMOVED) | F.col("known")), updated.generation_snippets(generation))
    summary = summary.withColumn("unchanged", unchanged)
    crowded = len(updated.generations) > options.max_generations
    if crowded or updated.logged > options.max_logged_share * max(updated.files, 1):
        updated = compact_index(spark, index.path)
    return IndexChange(updated, summary)
