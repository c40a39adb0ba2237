"""A stream of file changes that keeps an index current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed import Embedder
from ..plans.build import STREAM_MARK, IndexOptions
from ..plans.update import apply_changes
from ..sources.index import open_index


def stream_update(
    stream: DataFrame,
    index_path: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    options: IndexOptions = IndexOptions(),
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Apply (file_path, content, mtime, size, deleted) rows to the index as they arrive.

    The manifest is the state. Each micro-batch is one version of the index and leaves its
    number in the commit, under the stream's ``name`` (default: its checkpoint's path), so a
    batch replayed after a failure is recognised and skipped. A stream that starts over with an
    empty checkpoint counts from 0 again and needs another name.
    """
    mark = f"{STREAM_MARK}{name or checkpoint.rstrip('/')}"

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        if number <= int(open_index(spark, index_path).meta.get(mark, "-1")):
            return
        apply_changes(spark, index_path, batch, embedder, options, {mark: str(number)})

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
