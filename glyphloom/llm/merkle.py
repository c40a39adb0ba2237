"""Merkle manifest of a dataset, with checkpoints every few levels.

Each row is a leaf, the digest of its fields. The leaves of one language, by ascending key, are
paired into nodes, those again, until one is left: the language's subroot. The subroots, ordered by
language, are paired in the same way up to the root. A last node without a partner is hashed alone.

Leaves get their places by one range partition and the counts of its runs, so no task sees a whole
language. Only every ``EVERY`` levels the nodes are kept: 2^EVERY nodes in a row are an aligned
subtree, which one task folds without writing what lies between. To extract proofs the subtrees are
visited from the top down: each regenerates its missing nodes from the stored ones below, hands out
the siblings on the way up along with the path of its own top, and forgets them.

Nodes are sha256 over the lowercase hex text of what they join. A path lists, level by level, the
partner as ``L`` or ``R`` (the side it stands on) and its hex text, or ``-`` where there is none.

Defined results: null fields count as ``-``; null languages come first, as do null keys; rows of
equal key are ordered by their leaves; repeated rows are leaves of their own; an empty table has no
root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import folders
from .batches import few

#: Levels between two checkpoints.
EVERY = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, pos long, n long, node binary"


def joined(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row's fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    as_text = [c.cast("string") for c in fields]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def levels_within(n: int, every: int = EVERY) -> int:
    """Levels of a subtree on a level of n nodes: fewer where the tree ends in it."""
    return min(every, (n - 1).bit_length())


def regenerate(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a subtree, level by level; the first are those given, the last is the top."""
    made = [nodes]
    for _ in range(levels):
        below = made[-1]
        made.append([joined(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return made


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (tree, subtree) after the other; these are the first two columns, sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _gathered(nodes: DataFrame, every: int, *more: str) -> DataFrame:
    """Each subtree's nodes (tree, subtree, pos, n, node, ...) behind each other."""
    subtree = F.call_function("shiftright", F.col("pos"), F.lit(every)).alias("subtree")
    return nodes.select("tree", subtree, "pos", "n", "node", *more)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "subtree").sortWithinPartitions("tree", "subtree", "pos")


def _tops(nodes: DataFrame, every: int) -> DataFrame:
    """The top of each subtree: the nodes ``every`` levels above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for own in _subtrees(batches):
            tree, subtree, _, n, _ = own[0]
            top = regenerate([r[4].hex() for r in own], levels_within(n, every))[-1]
            rows.append((tree, subtree, -(-n >> every), bytes.fromhex(top[0])))
            if len(rows) == 4_096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["tree", "pos", "n", "node"])

    return _sorted(_gathered(nodes, every)).mapInArrow(run, NODES)


def _placed(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``rows`` with ``pos``, the place in its tree by ``order``, and ``n``, the size of the tree; written below ``folder``."""
    spark, columns = rows.sparkSession, rows.columns
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    # repeated rows are told apart, so that many of them do not meet in one partition
    dealt = rows.withColumn("copy", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, F.col("copy")).sortWithinPartitions(*keys, F.col("copy"))
    dealt.select(*columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).write.parquet(f"{folder}/dealt")
    dealt = spark.read.parquet(f"{folder}/dealt")
    # one row for each tree and partition
    runs = dealt.groupBy("tree", "part").agg(F.count("*").alias("length"), F.min("at").alias("begin"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    shift = F.coalesce(F.sum("length").over(earlier), F.lit(0)) - F.col("begin")
    runs = runs.select(F.col("tree").alias("run_tree"), F.col("part").alias("run_part"), shift.alias("shift"), F.sum("length").over(whole).alias("n"))
    found = dealt.join(few(runs), dealt["tree"].eqNullSafe(F.col("run_tree")) & (dealt["part"] == F.col("run_part")))
    found.select(*columns, (F.col("at") + F.col("shift")).alias("pos"), "n").write.parquet(f"{folder}/0")
    folders.remove(spark, f"{folder}/dealt")
    return spark.read.parquet(f"{folder}/0")


def _checkpoints(spark: SparkSession, folder: str, every: int) -> int:
    """Write the checkpoints above ``folder``/0 until each tree is down to its top; returns their number."""
    made = 0
    while True:
        nodes = spark.read.parquet(f"{folder}/{made}")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return made
        _tops(nodes, every).write.parquet(f"{folder}/{made + 1}")
        made += 1


def _paths(nodes: DataFrame, above: DataFrame, every: int, carried: list[str]) -> DataFrame:
    """(tree, pos, *carried, path) of each node. ``above``: (tree, pos, path) of the tops of their subtrees."""
    own_names = [f"own_{i}" for i in range(len(carried))]  # a node's digest may be carried as well
    nodes = nodes.select("*", *(F.col(c).alias(own) for c, own in zip(carried, own_names, strict=True)))
    empty = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("n", "node", *own_names)]
    tops = above.select("tree", F.col("pos").alias("subtree"), F.lit(-1).cast("long").alias("pos"), *empty, "path")
    rows = _sorted(_gathered(nodes, every, *own_names).withColumn("path", F.lit(None).cast("array<string>")).unionByName(tops))
    schema = rows.select("tree", "pos", *own_names, "path").schema
    # all but n and node, which only this step needs
    places = [0, 2, *range(5, 5 + len(carried))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for own in _subtrees(batches):
            up, own = own[0][-1], own[1:]
            made = regenerate([r[4].hex() for r in own], levels_within(own[0][3], every))
            partners = [[("-" if i ^ 1 >= len(x) else ("L" if i & 1 else "R") + x[i ^ 1]) for i in range(len(x))] for x in made[:-1]]
            for i, r in enumerate(own):
                rows.append((*(r[x] for x in places), [p[i >> level] for level, p in enumerate(partners)] + up))
            if len(rows) >= 1_024:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names, types = schema.names, [to_arrow_type(x.dataType) for x in schema]
    return rows.mapInArrow(run, schema).toDF("tree", "pos", *carried, "path")


@dataclass(frozen=True)
class Manifest:
    """A written manifest: the leaves and checkpoints of the languages, and of the tree of their subroots."""

    spark: SparkSession
    folder: str
    every: int = EVERY

    def checkpoint(self, number: int, part: str = "rows") -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}/{number}")

    def last(self, part: str = "rows") -> int:
        return max(int(x) for x in folders.names(self.spark, f"{self.folder}/{part}") if x.isdigit())

    def leaves(self) -> DataFrame:
        """(tree, doc_id, node, the carried columns, pos, n) of each row."""
        return self.checkpoint(0)

    def subroots(self) -> DataFrame:
        """(tree, subroot) of each language."""
        return self.checkpoint(self.last()).select("tree", hex_text(F.col("node")).alias("subroot"))

    def root(self) -> str | None:
        row = self.checkpoint(self.last("subroots"), "subroots").select("node").first()
        return row[0].hex() if row else None

    def paths(self, carried: list[str]) -> DataFrame:
        """(tree, pos, *carried, path) of every leaf, up to the root."""
        start = self.checkpoint(self.last("subroots"), "subroots")
        above = start.select("tree", "pos", F.array().cast("array<string>").alias("path"))
        for number in range(self.last("subroots") - 1, -1, -1):
            above = _paths(self.checkpoint(number, "subroots"), above, self.every, ["member"] if not number else [])
        if self.last("subroots"):
            above = above.select(F.col("member").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
        else:  # a single language: its subroot is the root
            above = start.select(F.col("member").alias("tree"), F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"))
        for number in range(self.last() - 1, -1, -1):
            above = _paths(self.checkpoint(number), above, self.every, carried if not number else [])
        if not self.last():  # every language has one row
            rows = self.leaves().select("tree", "pos", *carried)
            up = above.select(F.col("tree").alias("up_tree"), "path")
            above = rows.join(up, rows["tree"].eqNullSafe(F.col("up_tree"))).drop("up_tree")
        return above


def write_manifest(rows: DataFrame, folder: str, every: int = EVERY) -> Manifest:
    """Manifest of ``rows`` (tree, key, node and what else is to be carried along), below ``folder``."""
    spark = rows.sparkSession
    rows.withColumn("tree", F.col("tree").cast("string")).write.parquet(f"{folder}/given")
    _placed(spark.read.parquet(f"{folder}/given"), ["key", "node"], f"{folder}/rows")
    folders.remove(spark, f"{folder}/given")
    last = _checkpoints(spark, f"{folder}/rows", every)
    tops = spark.read.parquet(f"{folder}/rows/{last}").select(F.lit("").alias("tree"), F.col("tree").alias("member"), "node")
    _placed(tops, ["member"], f"{folder}/subroots")
    _checkpoints(spark, f"{folder}/subroots", every)
    return Manifest(spark, folder, every)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex text) and the partners on its path give."""

    def step(node: Column, partner: Column) -> Column:
        side, other = F.substring(partner, 1, 1), F.substring(partner, 2, 64)
        both = F.when(side == "L", F.concat(other, node)).when(side == "R", F.concat(node, other)).otherwise(node)
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def partners(path: Column) -> Column:
    """The partners' hex texts one after the other, leaf to root."""
    return F.array_join(F.transform(path, lambda p: F.substring(p, 2, 64)), "")
