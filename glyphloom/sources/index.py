"""The stored index: append-only parquet tables and a small commit file per version.

    <path>/snippets/generation=G          snippets and vectors that one version extracted
    <path>/files/generation=G/bucket=B    status, mtime, hash and places of the files it touched
    <path>/deletions/generation=G         bitmaps of the rows that it put out of use
    <path>/commits/N                      the generations of version N; it exists once this file does
    <path>/staged/S                       working tables of one attempt, removed after its commit

Every attempt writes under names of its own (version and a random part). The commit file names
them and appears at once and never over another (by a rename, on object stores by a conditional put): of two writers that started from the same
version one commits, the other gets ConcurrentWriteError and leaves folders that no commit names.
Leftovers of lost attempts are never read and never in the way; ``vacuum`` removes them together
with versions that are no longer wanted.

A full build starts over with one generation. An update only appends what changed, so its
cost follows the change and not the corpus. The file log knows where each file's snippets lie, so an
update marks the rows it replaces in bitmaps without a look at the snippets. Readers join the
bitmaps to the scan by data file and row number: they are broadcast, in portions of bounded size,
and no snippet is ever shuffled to be read. Compaction folds the generations into one.

The file log is dealt into buckets by a hash of the path, the more the larger the index was when it
was built. Who asks about some paths opens their buckets only.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import BROADCAST_BYTES, broadcast_within, upsert
from ..schema import CHUNK, DELETIONS, FILE_LOG, MANIFEST, NEW, REMOVED, SKIPPED, SNIPPETS, STORED_SNIPPETS
from . import folders

_GENERATION = T.StructField("generation", T.StringType())
_BUCKET = T.StructField("bucket", T.IntegerType())
#: Files in one bucket of the file log.
BUCKET_FILES = 100_000
#: Bytes that one bitmap takes as a join side.
BITMAP_BYTES = CHUNK // 8 + 256
#: Codec of tables that hold texts: a quarter smaller than Spark's default, for about the same time.
COMPRESSION = "zstd"
#: A written file without any snippet has a row without an id; its facts stand there, else with the first snippet.
FILE_FACTS = ("mtime", "content_hash")


def buckets_for(files: int) -> int:
    return max(1, -(-files // BUCKET_FILES))


class ConcurrentWriteError(RuntimeError):
    """Another writer has committed the version that this one was about to commit."""


@dataclass(frozen=True)
class SnippetIndex:
    """One committed version of the index at ``path``."""

    spark: SparkSession
    path: str
    version: int = 0
    generations: tuple[str, ...] = ()
    files: int = 0  # files in the manifest
    logged: int = 0  # rows logged since the last full build or compaction
    logged_bytes: int = 0  # and the bytes they take as a join side
    deleted_bytes: int = 0  # bytes of the bitmaps since then
    buckets: int = 1  # of the file log
    width: int | None = None  # of the vectors; None while there are none
    meta: dict[str, str] = field(default_factory=dict)

    def _read(self, table: str, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _logs(self, generations: tuple[str, ...], buckets: Iterable[int] | None = None) -> DataFrame:
        """File logs; ``generation`` becomes their place among all of them. ``buckets``: those to open."""
        paths = [f"{self.path}/files/generation={g}" for g in generations]
        if buckets is not None:
            wanted = {f"bucket={b}" for b in buckets}
            paths = [f"{p}/{b}" for p in paths for b in sorted(wanted.intersection(folders.names(self.spark, p)))]
        rows = self._read("files", paths, T.StructType([*FILE_LOG.fields, _GENERATION, _BUCKET]))
        names = F.lit(list(self.generations)).cast("array<string>")
        return rows.withColumn("generation", F.array_position(names, F.col("generation"))).drop("bucket")

    def file_log(self, generation: str) -> DataFrame:
        """What one generation did to which file."""
        return self._logs((generation,)).drop("generation")

    def _snippet_rows(self, paths: list[str], schema: T.StructType = STORED_SNIPPETS) -> DataFrame:
        """Rows of generations or data files, with their data file and row number there."""
        rows = self._read("snippets", paths, schema)
        if not paths:
            return rows.withColumns({"data_file": F.lit(""), "row": F.lit(0).cast("long")})
        return rows.select("*", F.col("_metadata.file_name").alias("data_file"), F.col("_metadata.row_index").alias("row"))

    def _snippet_paths(self, generations: tuple[str, ...]) -> list[str]:
        return [f"{self.path}/snippets/generation={g}" for g in generations]

    def generation_snippets(self, generation: str) -> DataFrame:
        rows = self._read("snippets", self._snippet_paths((generation,)), STORED_SNIPPETS)
        return rows.where(F.col("id").isNotNull())

    def deletions(self) -> DataFrame:
        """One bitmap for each chunk of a data file in which rows no longer count."""
        paths = [f"{self.path}/deletions/generation={g}" for g in self.generations[1:]]
        rows = self._read("deletions", paths, DELETIONS)
        # at most one bitmap from each generation; rows are put out of use once, so sums are unions
        both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
        zeros = F.array_repeat(F.lit(0).cast("long"), CHUNK // 64)
        words = F.aggregate(F.collect_list("words"), zeros, both)
        return rows.groupBy("data_file", "chunk").agg(words.alias("words"))

    def stored(self, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Current snippets with their vectors."""
        paths = self._snippet_paths(self.generations)
        if len(self.generations) < 2 or not self.deleted_bytes:
            return self._read("snippets", paths, STORED_SNIPPETS).where(F.col("id").isNotNull())
        portions = -(-self.deleted_bytes // broadcast_bytes)
        bitmaps = self.deletions()
        if portions == 1:
            return self._current(paths, bitmaps)
        dealt: list[list[str]] = [[] for _ in range(portions)]
        for path in self._read("snippets", paths, STORED_SNIPPETS).inputFiles():
            dealt[zlib.crc32(path.rpartition("/")[2].encode()) % portions].append(path)
        of = F.crc32(F.col("data_file").cast("binary")) % portions
        out = None
        for i, own in enumerate(dealt):
            rows = self._current(own, bitmaps.where(of == i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _current(self, paths: list[str], bitmaps: DataFrame) -> DataFrame:
        """Rows whose bit is not set. The bitmaps are broadcast: their size is known."""
        marks = bitmaps.select(F.col("data_file").alias("marked_file"), "chunk", "words")
        rows = self._snippet_rows(paths).where(F.col("id").isNotNull())
        chunk, inside = F.expr(f"row DIV {CHUNK}"), F.col("row") % CHUNK
        found = rows.join(F.broadcast(marks), (F.col("data_file") == F.col("marked_file")) & (chunk == F.col("chunk")), "left")
        word = F.col("words")[F.expr(f"CAST(row % {CHUNK} DIV 64 AS INT)")]
        gone = F.getbit(word, (inside % 64).cast("int")) == 1
        return found.where(F.col("words").isNull() | ~gone).select(*STORED_SNIPPETS.names)

    def snippets(self) -> DataFrame:
        return self.stored().select(*SNIPPETS.names)

    def vectors(self) -> DataFrame:
        return self.stored().select("id", "embedding")

    def bucket_of(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def buckets_of(self, paths: DataFrame) -> list[int]:
        """The buckets that some paths are in."""
        return [r[0] for r in paths.select(self.bucket_of(F.col("file_path"))).distinct().collect()]

    def _states(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The last thing that happened to each path."""
        logged = lambda g: self._logs(g, buckets).where(F.col("status") != SKIPPED)
        base = logged(self.generations[:1])
        if len(self.generations) < 2:
            return base
        return upsert(base, logged(self.generations[1:]), "file_path", "generation", self.logged_bytes)

    def manifest(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """(file_path, mtime, content_hash) of every indexed file."""
        kept = self._states(buckets).where(F.col("status") != REMOVED)
        return kept.select(*MANIFEST.names)

    def removals(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """(file_path, mtime) of paths that are gone; mtime is that of the deletion, or null."""
        return self._states(buckets).where(F.col("status") == REMOVED).select("file_path", "mtime")

    def places(self, paths: DataFrame) -> DataFrame:
        """(file_path, data_file, first, rows): where the snippets of some files lie now.

        A file that was only touched has its snippets where an earlier generation put them.
        """
        wrote = F.col("places").isNotNull()
        rows = self._logs(self.generations, self.buckets_of(paths)).where(wrote)
        rows = rows.join(paths.select("file_path"), "file_path", "left_semi")
        last = rows.groupBy("file_path").agg(F.max_by("places", "generation").alias("places"))
        return last.select("file_path", F.inline("places"))

    def meta_frame(self) -> DataFrame:
        schema = "key string, value string"
        return self.spark.createDataFrame(sorted(self.meta.items()), schema)

    # -- writing the next version ------------------------------------------------------

    def new_generation(self) -> str:
        """A name that no other attempt has."""
        return f"{self.version + 1}-{uuid.uuid4().hex}"

    def staging(self) -> str:
        """A folder for the working tables of one attempt."""
        return f"{self.path}/staged/{uuid.uuid4().hex}"

    def write_files(self, generation: str, log: DataFrame) -> None:
        """The log with its places; a file that got new snippets has places, perhaps none of them."""
        rows = log.select(*FILE_LOG.names, self.bucket_of(F.col("file_path")).alias("bucket"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/files/generation={generation}")

    def write_snippets(self, generation: str, snippets: DataFrame) -> tuple[int, int | None]:
        """Returns the number of files among the rows that carry file facts, and the vectors' width.

        Rows of one file lie together; bloom filters on id serve point look-ups. Vectors of more than one
        width, or of another one than the index holds, raise a ValueError, and nothing is committed.
        """
        facts = [c for c in FILE_FACTS if c in snippets.columns]
        width = F.when(F.col("id").isNotNull(), F.coalesce(F.size("embedding"), F.lit(0)))
        starts = F.coalesce(F.col("ordinal"), F.lit(0)) == 0
        seen = Observation()
        (
            snippets.select(*STORED_SNIPPETS.names, *facts)
            .observe(seen, F.min(width).alias("low"), F.max(width).alias("high"), F.count_if(starts).alias("files"))
            .write.option("compression", COMPRESSION)
            .option("parquet.bloom.filter.enabled#id", "true")
            .option("parquet.bloom.filter.expected.ndv#id", "100000")
            .parquet(f"{self.path}/snippets/generation={generation}")
        )
        found = seen.get
        low, high, held = found["low"], found["high"], self.width
        if low != high or (held is not None and high is not None and high != held):
            raise ValueError(f"vectors of widths {low} to {high}, where the index holds {held or 'none'}")
        return found["files"], high if high is not None else held

    def written(self, generation: str, facts: bool = False) -> DataFrame:
        """(file_path, places) of the files a generation holds snippets of, and its file facts if they were written."""
        kinds = {x.name: x for x in MANIFEST.fields}
        fields = [STORED_SNIPPETS["id"], STORED_SNIPPETS["file_path"], *((kinds[c] for c in FILE_FACTS) if facts else ())]
        own = [F.max(c).alias(c) for c in FILE_FACTS] if facts else []
        rows = self._snippet_rows(self._snippet_paths((generation,)), T.StructType(fields))
        holds = F.col("id").isNotNull()
        first, last = (f(F.when(holds, F.col("row"))) for f in (F.min, F.max))
        runs = rows.groupBy("file_path", "data_file").agg(first.alias("first"), last.alias("last"), F.count_if(holds).alias("rows"), *own)
        whole = (F.col("rows") == 0) | (F.col("rows") == F.col("last") - F.col("first") + 1)
        count = F.when(whole, F.col("rows")).otherwise(F.raise_error(F.lit("the rows of a file do not lie together")).cast("long"))
        run = F.when(count > 0, F.struct("data_file", "first", count.alias("rows")))
        return runs.groupBy("file_path").agg(F.collect_list(run).alias("places"), *own)

    def write_deletions(self, generation: str, paths: DataFrame) -> int:
        """Put all snippets of some files out of use; returns the bytes of the bitmaps."""
        folder = f"{self.path}/deletions/generation={generation}"
        last = F.col("first") + F.col("rows") - 1
        rows = self.places(paths).select("data_file", F.explode(F.sequence(F.col("first"), last)).alias("row"))
        bit = F.expr("shiftleft(1L, CAST(row % 64 AS INT))")
        word = F.expr(f"CAST(row % {CHUNK} DIV 64 AS INT)").alias("word")
        words = rows.groupBy("data_file", F.expr(f"row DIV {CHUNK}").alias("chunk"), word).agg(F.bit_or(bit).alias("bits"))
        held = words.groupBy("data_file", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
        every = F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1))
        filled = F.transform(every, lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long")))
        held.select("data_file", "chunk", filled.alias("words")).write.parquet(folder)
        return self._read("deletions", [folder], DELETIONS).count() * BITMAP_BYTES

    def commit(self, **made) -> SnippetIndex:
        """Make the next version visible: this one with the fields ``made``."""
        later = replace(self, version=self.version + 1, **made)
        kept = {k: v for k, v in vars(later).items() if k not in ("spark", "path", "version")}
        try:
            folders.write_new(self.spark, f"{self.path}/commits/{later.version}", json.dumps(kept))
        except FileExistsError:
            raise ConcurrentWriteError(f"version {later.version} of {self.path} is there already") from None
        return later

    def commit_whole(self, generation: str, files: int, width: int | None, meta: dict[str, str]) -> SnippetIndex:
        """Commit a version that one generation makes up; buckets are those its log was written in."""
        return self.commit(generations=(generation,), files=files, logged=0, logged_bytes=0, deleted_bytes=0, width=width, meta=meta)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, the newest first."""
    found = folders.names(spark, f"{path.rstrip('/')}/commits")
    return sorted((int(n) for n in found if n.isascii() and n.isdigit()), reverse=True)


def read_version(spark: SparkSession, path: str, version: int) -> SnippetIndex:
    path = path.rstrip("/")
    made = json.loads(folders.read_text(spark, f"{path}/commits/{version}"))
    made["generations"] = tuple(made["generations"])
    return SnippetIndex(spark, path, version, **made)


def latest_version(spark: SparkSession, path: str) -> SnippetIndex:
    """The newest committed version; version 0 without generations where there is none."""
    found = versions(spark, path)
    return read_version(spark, path, found[0]) if found else SnippetIndex(spark, path.rstrip("/"))


def open_index(spark: SparkSession, path: str) -> SnippetIndex:
    index = latest_version(spark, path)
    if not index.generations:
        raise FileNotFoundError(f"no index at {path}; build one first")
    return index


def write_index(
    spark: SparkSession,
    path: str,
    stored: DataFrame,
    manifest: DataFrame,
    meta: dict[str, str],
) -> SnippetIndex:
    """Full overwrite with given snippets (with vectors), manifest and meta."""
    index = replace(latest_version(spark, path), width=None)
    log = manifest.withColumns({"status": F.lit(NEW), "known": F.lit(False)})
    # given rows come in any order: those of a file have to lie together
    return _write_whole(index, stored.sortWithinPartitions("file_path"), log, manifest.count(), meta)


def _write_whole(index: SnippetIndex, stored: DataFrame, log: DataFrame, files: int, meta: dict[str, str]) -> SnippetIndex:
    generation = index.new_generation()
    index = replace(index, buckets=buckets_for(files))
    _, width = index.write_snippets(generation, stored)
    empty = F.array().cast(FILE_LOG["places"].dataType)
    log = log.join(index.written(generation), "file_path", "left").withColumn("places", F.coalesce("places", empty))
    index.write_files(generation, log)
    return index.commit_whole(generation, files, width, meta)


def compact_index(spark: SparkSession, path: str) -> SnippetIndex:
    """Rewrite the current rows as one generation, so that reads join nothing."""
    index = open_index(spark, path)
    if len(index.generations) < 2:
        return index
    columns = ["file_path", "mtime", "content_hash", "status", "known"]
    here = index.manifest().withColumns({"status": F.lit(NEW), "known": F.lit(False)})
    # removals stay on record: a late message must not bring a file back
    gone = index.removals().withColumns(
        {"content_hash": F.lit(None).cast("string"), "status": F.lit(REMOVED), "known": F.lit(True)}
    )
    log = here.select(*columns).unionByName(gone.select(*columns))
    return _write_whole(index, index.stored(), log, index.files, index.meta)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the newest ``keep`` versions, and what lost attempts have left.

    Not to be run while another writer is at work: its folders belong to no version yet.
    """
    path = path.rstrip("/")
    found = versions(spark, path)
    used = {g for v in found[: max(keep, 1)] for g in read_version(spark, path, v).generations}
    for version in found[max(keep, 1) :]:
        folders.remove(spark, f"{path}/commits/{version}")
    for table in ("snippets", "files", "deletions"):
        for name in folders.names(spark, f"{path}/{table}"):
            if name.removeprefix("generation=") not in used:
                folders.remove(spark, f"{path}/{table}/{name}")
    folders.remove(spark, f"{path}/staged")
