"""Full build: filter, decode, extract, embed, store."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import build_summary
from ..operators.embed import Embedder, embed_snippets
from ..operators.extract import extract_snippets
from ..operators.filters import indexable_files, passes_path
from ..schema import EMBED_BATCH, ID_LENGTH, MAX_BLOCK_LINES, MAX_FILE_BYTES, MIN_BLOCK_LINES, NEW
from ..sources.index import FILE_FACTS, SnippetIndex, buckets_for, latest_version
from ..sources.tables import decode_files, hash_files

STREAM_MARK = "stream "
Reader = Callable[[DataFrame], DataFrame]  # listed files -> the same files with content


@dataclass(frozen=True)
class IndexOptions:
    """What is indexed and how; all but the filters and the last two must stay as it was built.

    An update compacts the index beyond ``max_generations``, or when the files logged since the
    last full build exceed ``max_logged_share`` of all files.
    """

    languages: Iterable[str] | None = None
    ignore_patterns: Iterable[str] | None = None
    ignore_dirs: Iterable[str] | None = None
    extensions: Mapping[str, str] | None = None
    max_bytes: int = MAX_FILE_BYTES
    max_lines: int = MAX_BLOCK_LINES
    min_lines: int = MIN_BLOCK_LINES
    id_length: int = ID_LENGTH
    batch_size: int = EMBED_BATCH
    max_generations: int = 24
    max_logged_share: float = 0.25

    def takes_path(self, path: Column) -> Column:
        """The filters that a path alone decides."""
        return passes_path(path, self.languages, self.ignore_patterns, self.ignore_dirs, self.extensions)

    def keep(self, files: DataFrame) -> DataFrame:
        return indexable_files(
            files,
            self.languages,
            self.ignore_patterns,
            self.ignore_dirs,
            self.extensions,
            self.max_bytes,
        )

    def snippets(self, texts: DataFrame, embedder: Embedder) -> DataFrame:
        """Embedded snippets of decoded files."""
        rows = extract_snippets(texts, self.max_lines, self.min_lines, self.id_length)
        return embed_snippets(rows, embedder, self.batch_size)

    def snippets_and_files(self, texts: DataFrame, embedder: Embedder) -> DataFrame:
        """The same rows with mtime and hash beside each file's first one; a file without any has one without an id."""
        rows = extract_snippets(texts, self.max_lines, self.min_lines, self.id_length, carry=FILE_FACTS)
        return embed_snippets(rows, embedder, self.batch_size)


@dataclass(frozen=True)
class IndexChange:
    """The version an operation committed, and its one-row summary."""

    index: SnippetIndex
    summary: DataFrame


def build_index(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    embedder: Embedder,
    options: IndexOptions = IndexOptions(),
    read_content: Reader | None = None,
    source: str = "",
) -> IndexChange:
    """Index ``files`` at ``path``, replacing what was there.

    ``files`` carries ``content`` itself, or ``read_content`` fetches it (a listed tree).
    The content is read once: snippets and the facts about their files are one write, from which
    the file log and the counts are then taken. A mtime is that of the listing, so a file that changes
    while snippets are extracted shows a newer one to the next update.
    """
    before = latest_version(spark, path)
    generation = before.new_generation()
    kept = options.keep(files)
    texts = hash_files(decode_files(read_content(kept) if read_content else kept))
    index = replace(before, width=None)
    n_files, width = index.write_snippets(generation, options.snippets_and_files(texts, embedder))
    index = replace(index, buckets=buckets_for(n_files))
    index.write_files(generation, index.written(generation, facts=True).withColumns({"status": F.lit(NEW), "known": F.lit(False)}))
    # where streams have got to outlives a full build
    marks = {k: v for k, v in index.meta.items() if k.startswith(STREAM_MARK)}
    meta = {**marks, "model_name": embedder.name, "source_directory": source}
    index = index.commit_whole(generation, n_files, width, meta)
    return IndexChange(index, build_summary(index.file_log(generation), index.generation_snippets(generation)))
