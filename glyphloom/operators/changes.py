"""File status, snippet replacement and the counts reported about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHANGED, NEW, REMOVED, SKIPPED, TOUCHED, UNCHANGED


BROADCAST_BYTES = 256 << 20


def join_bytes(path: Column) -> Column:
    """Bytes rows of this key take as the broadcast side of a join, with some overhead."""
    return F.coalesce(F.sum(F.octet_length(path).cast("long") + 64), F.lit(0))


def broadcast_within(side: DataFrame, size: int) -> DataFrame:
    """Broadcast a join side whose size was found to be small; else leave it to be shuffled."""
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def compare_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """All paths of both sides, with ``present`` and ``known`` for the side each is on.

    ``files`` keeps its columns; the manifest's become known_mtime and known_hash.
    """
    old = manifest.select(
        "file_path",
        F.col("mtime").alias("known_mtime"),
        F.col("content_hash").alias("known_hash"),
        F.lit(True).alias("known"),
    )
    both = files.withColumn("present", F.lit(True)).join(old, "file_path", "full")
    sides = {side: F.coalesce(side, F.lit(False)) for side in ("present", "known")}
    return both.withColumns(sides)


def same_mtime() -> Column:
    """Whether a compared file is trusted to be as it was; an unknown mtime never is."""
    return F.col("present") & F.col("known") & F.coalesce(F.col("mtime") == F.col("known_mtime"), F.lit(False))


def file_status() -> Column:
    """Status of a compared file with its content_hash; a null hash means that it has no text."""
    return (
        F.when(~F.col("present"), REMOVED)
        .when(same_mtime(), UNCHANGED)
        .when(F.col("content_hash").isNull(), SKIPPED)
        .when(~F.col("known"), NEW)
        .when(F.col("content_hash") == F.col("known_hash"), TOUCHED)
        .otherwise(CHANGED)
    )


def classify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, status) of files (file_path, mtime, content_hash) against a manifest."""
    both = compare_files(files.select("file_path", "mtime", "content_hash"), manifest)
    return both.where("present").select("file_path", file_status().alias("status"))


def removed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths the manifest knows and the files no longer hold."""
    return manifest.select("file_path").join(files.select("file_path"), "file_path", "left_anti")


def file_paths(manifest: DataFrame) -> DataFrame:
    return manifest.select("file_path").distinct()


def delete_by_file(snippets: DataFrame, paths: DataFrame) -> DataFrame:
    """Snippets of all files but the given ones."""
    return snippets.join(paths.select("file_path"), "file_path", "left_anti")


def newest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; combined before the shuffle."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return newest.select("r.*")


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: str,
    sequence: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """Existing rows with incoming ones put in their place by key.

    ``sequence`` names the incoming column that orders rows of one key (the last one wins);
    without it the incoming keys are taken to be unique. ``size``: bytes of the incoming keys,
    where they are known.
    """
    if sequence is not None:
        incoming = newest_per_key(incoming, key, sequence)
    keys = incoming.select(key)
    keys = keys if size is None else broadcast_within(keys, size)
    kept = existing.join(keys, key, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def count_snippets(snippets: DataFrame) -> DataFrame:
    return snippets.agg(F.count("*").alias("snippets"))


def build_summary(files: DataFrame, snippets: DataFrame) -> DataFrame:
    """(files_scanned, snippets_indexed); files without any snippet count as scanned."""
    scanned = files.agg(F.count("file_path").alias("n"), F.lit(0).cast("long").alias("m"))
    indexed = snippets.agg(F.lit(0).cast("long").alias("n"), F.count("id").alias("m"))
    return scanned.unionByName(indexed).agg(
        F.sum("n").alias("files_scanned"), F.sum("m").alias("snippets_indexed")
    )


def update_summary(status: DataFrame, new_snippets: DataFrame) -> DataFrame:
    """(added, changed, removed, unchanged, snippets_indexed); touched files are unchanged."""
    counts = {
        "added": F.col("status") == NEW,
        "changed": F.col("status") == CHANGED,
        "removed": F.col("status") == REMOVED,
        "unchanged": F.col("status").isin(UNCHANGED, TOUCHED),
    }
    files = status.agg(*[F.count_if(test).alias(name) for name, test in counts.items()])
    return files.withColumn("snippets_indexed", F.lit(0).cast("long")).unionByName(
        new_snippets.agg(
            *[F.lit(0).cast("long").alias(name) for name in counts],
            F.count("*").alias("snippets_indexed"),
        )
    ).agg(*[F.sum(name).alias(name) for name in [*counts, "snippets_indexed"]])


def list_snippets(snippets: DataFrame) -> DataFrame:
    return snippets.orderBy("file_path", "start_line", "ordinal")


