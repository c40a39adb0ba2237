"""One query per operator, on the test tables. ``oracles`` holds the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, vectors
from ..operators import blocks, changes, embed, extract, filters, present, search
from ..plans import find as finding
from ..plans.build import IndexChange, build_index
from ..plans.update import update_index
from ..sources.index import COMPRESSION, SnippetIndex, open_index, read_version, write_index
from ..sources.scratch import scratch_folder
from ..sources.tables import decode_files, files_from_table, hash_files
from ..sources.tree import mounted_path, scan_tree
from ..streaming.updates import stream_update
from . import corpora as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _embedder() -> embed.KeywordEmbedder:
    return embed.KeywordEmbedder(C.VOCABULARY)


def _vector_text(v: Column) -> Column:
    """Vector in hundredths as text, which compares exactly everywhere."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 100).cast("int").cast("string")), ",")


def _prose(spark: SparkSession, folder: str) -> DataFrame:
    return C.prose_files(C.table(spark, folder, "documents"))


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return C.code_files(C.table(spark, folder, "documents"))


def _code_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_snippets(_code(spark, folder))


def _built(spark: SparkSession, folder: str, files: DataFrame) -> IndexChange:
    files = files_from_table(files)
    return build_index(spark, f"{scratch_folder(spark)}/index", files, _embedder(), source="documents")


def _prose_index(spark: SparkSession, folder: str) -> SnippetIndex:
    return _built(spark, folder, _prose(spark, folder)).index


def _updated(spark: SparkSession, folder: str) -> IndexChange:
    old, new = C.snapshots(spark, folder)
    built = build_index(spark, f"{scratch_folder(spark)}/index", old, _embedder())
    return update_index(spark, built.index.path, new)


def _rows(index: SnippetIndex) -> DataFrame:
    """Everything an index holds, one row per snippet."""
    hashes = index.manifest().select("file_path", "content_hash", "mtime")
    rows = index.stored().join(hashes, "file_path")
    vector = _vector_text(F.col("embedding")).alias("vector")
    columns = ["id", "file_path", "start_line", "end_line", "kind", "language", "content"]
    return rows.select(*columns, vector, "content_hash", "mtime")


# -- sources, decoding, projections --------------------------------------------------


@query
def files_table(spark, folder):
    files = files_from_table(_prose(spark, folder))
    return hash_files(files).select("file_path", "mtime", "size", "content_hash")


@query
def files_table_relative(spark, folder):
    """Paths written in several ways below a folder, some without a size."""
    root = "/data/build/corpus"
    turn = F.col("doc_id") % 4
    path = (
        F.when(turn == 0, F.concat(F.lit(root + "/"), "file_path"))
        .when(turn == 1, F.concat(F.lit("./"), "file_path"))
        .when(turn == 2, F.concat(F.lit(root + "//./"), F.replace("file_path", F.lit("/"), F.lit("//"))))
        .otherwise(F.col("file_path"))
    )
    rows = _prose(spark, folder).withColumns({"path": path, "bytes": F.when(turn != 1, F.octet_length("content"))})
    files = files_from_table(rows, path="path", size="bytes", root=root)
    kept = hash_files(filters.indexable_files(files, max_bytes=2000))
    return kept.select("file_path", "language", "content_hash")


@query
def tree_scan(spark, folder):
    root = f"{scratch_folder(spark)}/tree"
    _write_tree(_code(spark, folder).select("file_path", "content"), root)
    _write_tree(C.path_files(spark, folder).withColumn("content", F.lit("x\n")), root)
    files = scan_tree(spark, root, ignore_patterns=["lib/", "*.test.*"], languages=["python", "javascript", "dart"])
    files = hash_files(decode_files(files))
    return files.select("file_path", "size", "language", "content_hash")


def _write_tree(files: DataFrame, root: str) -> None:
    """Write one file per row, on the executors."""
    base = mounted_path(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for row in batch.to_pylist():
                target = os.path.join(base, row["file_path"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(row["content"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("file_path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@query
def decode_text(spark, folder):
    files = decode_files(C.byte_files(spark, folder))
    return files.select("doc_id", text.content_hash(F.col("content")).alias("content_hash"))


@query
def language_for(spark, folder):
    path = F.col("file_path")
    return C.path_files(spark, folder).select(path, paths.language_for(path).alias("language"))


@query
def content_hash(spark, folder):
    docs = C.table(spark, folder, "documents")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query
def snippet_id(spark, folder):
    lines = F.size(text.split_lines(F.col("content")))
    explicit = F.when(F.col("lang") == "es", F.concat(F.lit("own"), "source"))
    args = F.col("file_path"), F.lit(1), lines, F.col("content")
    return _prose(spark, folder).select(
        "file_path",
        text.snippet_id(*args).alias("id"),
        text.snippet_id(*args, length=64).alias("long_id"),
        text.snippet_id(*args, explicit=explicit).alias("given_id"),
    )


@query
def snippet_shape(spark, folder):
    start, end = F.col("start_line"), F.col("end_line")
    return blocks.split_blocks(_prose(spark, folder)).select(
        "id",
        text.line_count(start, end).alias("line_count"),
        text.location(F.col("file_path"), start).alias("location"),
    )


@query
def embedding_text(spark, folder):
    made = text.embedding_text(F.col("language"), F.col("name"), F.col("content"))
    return _code_snippets(spark, folder).select("id", made.alias("embedding_text"))


@query
def hit_header(spark, folder):
    rows = _code_snippets(spark, folder).withColumns(
        {"rank": F.col("ordinal") + 1, "score": F.length("content") / F.lit(4096.0)}
    )
    return present.format_hits(rows).select("id", "header")


@query
def preview(spark, folder):
    docs = C.table(spark, folder, "documents")
    return docs.select("doc_id", text.preview(F.col("text")).alias("preview"))


# -- filters -------------------------------------------------------------------------


@query
def filter_extensions(spark, folder):
    return filters.filter_extensions(C.path_files(spark, folder))


@query
def filter_languages(spark, folder):
    files = C.path_files(spark, folder)
    some = filters.filter_languages(files, ["dart", "python", "cobol"])
    return some.unionByName(filters.filter_languages(files, []))


@query
def filter_ignored_dirs(spark, folder):
    return filters.filter_ignored_dirs(C.path_files(spark, folder))


@query
def filter_globs(spark, folder):
    patterns = ["lib/", "*.test.*", "src/src1[!0-4]/*", ".d??.js"]
    return filters.filter_ignore_patterns(C.path_files(spark, folder), patterns)


@query
def filter_size(spark, folder):
    return filters.filter_size(C.path_files(spark, folder), 3000)


# -- extraction ----------------------------------------------------------------------


def _spans(spark: SparkSession, folder: str, stage: Callable[[Column], Column]) -> DataFrame:
    spans = text.let(text.split_lines(F.col("content")), stage)
    rows = _prose(spark, folder).select("file_path", F.explode(spans).alias("b"))
    return rows.select(
        "file_path", (F.col("b.first") + 1).alias("start_line"), (F.col("b.last") + 1).alias("end_line")
    )


@query
def block_islands(spark, folder):
    return _spans(spark, folder, blocks.block_islands)


@query
def block_merge(spark, folder):
    return _spans(spark, folder, lambda s: blocks.merge_blocks(blocks.block_islands(s)))


@query
def block_chunk(spark, folder):
    merged = lambda s: blocks.merge_blocks(blocks.block_islands(s))
    return _spans(spark, folder, lambda s: blocks.chunk_blocks(merged(s), 10))


@query
def split_blocks(spark, folder):
    return blocks.split_blocks(_prose(spark, folder))


@query
def extract_python(spark, folder):
    return extract.extract_python(_code(spark, folder))


@query
def extract_braces(spark, folder):
    return extract.extract_braces(_code(spark, folder))


@query
def extract_leftovers(spark, folder):
    return extract.leftovers(_code(spark, folder)).drop("ordinal")


@query
def extract_snippets(spark, folder):
    return extract.extract_snippets(C.all_files(spark, folder))


# -- changes and counts --------------------------------------------------------------


def _manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Old manifest, and the new files with hashes (null where they are binary)."""
    old, new = C.snapshots(spark, folder)
    hashed = lambda df: df.withColumn("content_hash", text.content_hash(text.decode_text(F.col("content"))))
    columns = ["file_path", "mtime", "content_hash"]
    return hashed(old).select(*columns), hashed(new).select(*columns)


@query
def classify_files(spark, folder):
    old, new = _manifests(spark, folder)
    return changes.classify_files(new, old)


@query
def removed_files(spark, folder):
    old, new = _manifests(spark, folder)
    return changes.removed_files(old, new)


@query
def file_paths(spark, folder):
    old, new = _manifests(spark, folder)
    return changes.file_paths(old.unionByName(new))


@query
def manifest_upsert(spark, folder):
    old, new = _manifests(spark, folder)
    return changes.upsert(old, new, "file_path")


@query
def meta_upsert(spark, folder):
    docs = C.table(spark, folder, "documents")
    meta = docs.groupBy(F.col("lang").alias("key")).agg(F.count("*").cast("string").alias("value"))
    later = docs.select(F.when(F.col("lang") == "en", F.col("source")).otherwise(F.col("lang")).alias("key"), "doc_id")
    later = later.groupBy("key").agg(F.max("doc_id").cast("string").alias("value"))
    return changes.upsert(meta, later, "key")


@query
def upsert_snippets(spark, folder):
    old, new = C.snapshots(spark, folder)
    cut = lambda df: blocks.split_blocks(filters.filter_extensions(decode_files(df))).drop("ordinal")
    again = F.when(F.col("language") == "python", "third").otherwise("second")
    first = cut(new).withColumn("turn", F.lit(1))
    second = cut(new).where(F.col("language") != "go").withColumns({"turn": F.lit(2), "kind": again})
    merged = changes.upsert(cut(old), first.unionByName(second), "id", "turn")
    return merged.select("id", "file_path", "start_line", "end_line", "kind")


@query
def delete_by_file(spark, folder):
    old, new = _manifests(spark, folder)
    kept = changes.delete_by_file(blocks.split_blocks(_prose(spark, folder)), changes.removed_files(old, new))
    return kept.select("id", "file_path")


# -- vectors -------------------------------------------------------------------------


@query
def l2_normalize(spark, folder):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    unit = C.vectors(spark, folder).select("id", vectors.l2_normalize(scaled).alias("v"))
    cells = unit.select("id", F.posexplode("v").alias("pos", "x"))
    return cells.select("id", "pos", F.round("x", 6).alias("x"))


@query
def cosine_pairs(spark, folder):
    centres = C.centroids(spark, folder).withColumnsRenamed({"query_id": "label", "embedding": "centre"})
    pairs = C.vectors(spark, folder).join(centres, "label")
    score = vectors.cosine(F.col("embedding"), F.col("centre"))
    return pairs.select("id", "label", F.round(score, 6).alias("score"))


def _hits(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


@query
def vector_topk(spark, folder):
    return _hits(search.top_k(C.vectors(spark, folder), C.centroids(spark, folder), 10))


@query
def vector_topk_cells(spark, folder):
    """The same search by the route for query sets too large to broadcast."""
    found = search.top_k(
        C.vectors(spark, folder), C.centroids(spark, folder), 10, broadcast_bytes=0, cell_bytes=1 << 20
    )
    return _hits(found)


@query
def topk_edges(spark, folder):
    """k beyond the number of vectors gives all of them, k = 0 none."""
    queries = C.centroids(spark, folder)
    found = queries.withColumnRenamed("query_id", "id")
    return _hits(search.top_k(found, queries, 500).unionByName(search.top_k(found, queries, 0)))


@query
def vector_dim(spark, folder):
    return search.check_dimension(C.vectors(spark, folder))


@query
def embed_keyword(spark, folder):
    docs = embed.embed(C.table(spark, folder, "documents"), "text", _embedder())
    return docs.select("doc_id", _vector_text(F.col("embedding")).alias("vector"))


def _letters(texts):
    """Length and counts of two letters, as a model that a worker loads."""
    return np.array([[len(t) % 97, t.count("e") % 89, t.count("\n") % 7] for t in texts], dtype=np.float32)


@query
def embed_batched(spark, folder):
    """Embedding in Arrow batches, with a model of its own in each Python worker."""
    model = embed.ModelEmbedder("letters", load=lambda: _letters)
    docs = embed.embed(C.table(spark, folder, "documents"), "text", model)
    return docs.select("doc_id", _vector_text(F.col("embedding")).alias("vector"))


@query
def embed_snippets(spark, folder):
    rows = embed.embed_snippets(_code_snippets(spark, folder), _embedder())
    return rows.select("id", _vector_text(F.col("embedding")).alias("vector"))


# -- the stored index ----------------------------------------------------------------


@query
def index_roundtrip(spark, folder):
    files = hash_files(_prose(spark, folder))
    stored = embed.embed_snippets(blocks.split_blocks(files), _embedder())
    path = f"{scratch_folder(spark)}/index"
    write_index(spark, path, stored, files.select("file_path", "mtime", "content_hash"), {"a": "b"})
    return _rows(open_index(spark, path))


@query
def index_count(spark, folder):
    return finding.count_snippets(_prose_index(spark, folder))


@query
def list_snippets(spark, folder):
    columns = ["file_path", "start_line", "end_line", "id"]
    return finding.list_snippets(_prose_index(spark, folder)).select(*columns)


@query
def show(spark, folder):
    index = _prose_index(spark, folder)
    smallest = index.snippets().agg(F.min("id")).first()[0]
    return finding.show(index, smallest).drop("ordinal", "name")


@query
def build_index_rows(spark, folder):
    return _rows(_built(spark, folder, C.all_files(spark, folder)).index)


@query
def build_summary(spark, folder):
    return _built(spark, folder, C.all_files(spark, folder)).summary


@query
def update_index_rows(spark, folder):
    return _rows(_updated(spark, folder).index)


@query
def index_versions(spark, folder):
    """Both versions of an updated index, read side by side."""
    updated = _updated(spark, folder).index
    before = read_version(spark, updated.path, 1)
    rows = [_rows(x).select(F.lit(n).alias("version"), "*") for n, x in ((1, before), (2, updated))]
    return rows[0].unionByName(rows[1])


@query
def update_summary(spark, folder):
    return _updated(spark, folder).summary


@query
def stream_update_rows(spark, folder):
    """The same changes as a stream of files; removals arrive as deletion rows."""
    old, new = C.snapshots(spark, folder)
    home = scratch_folder(spark)
    build_index(spark, f"{home}/index", old, _embedder())
    feed = new.withColumn("deleted", F.lit(False))
    # a deletion of each file that is gone, and a late row of each that is still there
    there = changes.file_paths(new).withColumn("there", F.lit(True))
    rest = old.where(F.col("file_path").isNotNull()).join(there, "file_path", "left")
    rest = rest.withColumns({"deleted": F.col("there").isNull(), "mtime": F.col("mtime") + F.when(F.col("there"), -1).otherwise(9)})
    feed.unionByName(rest.drop("there")).write.option("compression", COMPRESSION).parquet(f"{home}/feed")
    stream = spark.readStream.schema(feed.schema).parquet(f"{home}/feed")
    stream_update(stream, f"{home}/index", f"{home}/stream").awaitTermination()
    return _rows(open_index(spark, f"{home}/index"))


@query
def stream_excluded_rows(spark, folder):
    """A feed of files that grow past the size limit, of deletions without mtime and at the known
    one, of rows that do not say whether they are deleted, and of late rows in a second batch."""
    files = _prose(spark, folder).select("doc_id", "file_path", "content", "mtime")
    home, turn = scratch_folder(spark), F.col("doc_id") % 5
    build_index(spark, f"{home}/index", files_from_table(files), _embedder())
    size = F.when(turn == 0, F.lit(5_000_000)).otherwise(F.octet_length("content")).cast("long")
    deleted = F.when(turn.isin(1, 2), F.lit(True)).when(turn == 0, F.lit(False))
    mtime = F.when(turn == 0, F.col("mtime") + 1).when(turn == 2, F.col("mtime")).when(turn == 3, F.col("mtime") + 2)
    content = F.when(turn == 3, F.concat("content", F.lit("\n\nnow\nwith\nmore"))).otherwise(F.col("content"))
    columns = {"content": content, "size": size, "deleted": deleted, "mtime": mtime}
    first = files.where(turn < 4).withColumns(columns).drop("doc_id")
    late = {"content": F.lit("late\n\n"), "size": F.lit(6).cast("long"), "deleted": turn == 4, "mtime": F.col("mtime") + F.when(turn == 3, 1).otherwise(-1)}
    second = files.where(turn >= 2).where(turn != 2).withColumns(late).drop("doc_id")
    for number, rows in enumerate((first, second)):
        rows.write.parquet(f"{home}/feed-{number}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{home}/feed-{number}")
        stream_update(stream, f"{home}/index", f"{home}/stream-{number}").awaitTermination()
    return _rows(open_index(spark, f"{home}/index"))


@query
def find(spark, folder):
    queries = C.table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = finding.find(_prose_index(spark, folder), queries, 5)
    columns = ["query_id", "rank", "id", "score", "file_path", "start_line", "header", "preview"]
    return _hits(hits.select(*columns))


@query
def find_hydrated(spark, folder):
    """Hits whose snippet is gone drop out and leave a gap in the ranks."""
    index = _prose_index(spark, folder)
    queries = C.table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = finding.search(index, embed.embed(queries, "text", _embedder()), 8)
    kept = index.snippets().where(F.col("language") != "go")
    rows = present.hydrate(hits, kept).select("query_id", "rank", "id", "score", "content")
    return _hits(rows)
