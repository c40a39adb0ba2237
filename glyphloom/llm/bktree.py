"""SimHash fingerprints, linked with BK-trees.

Texts give 64-bit fingerprints; equal ones collapse before anything is compared. Fingerprints that
differ in at most r bits agree in some two of r + 2 bit blocks, so each goes to one shard per choice
of two blocks, whatever the size of the input. A shard's fingerprints form a BK-tree, children keyed
by their Hamming distance to the parent; a search follows only edges within r of its own distance.

Shards larger than a bound are cut into parts. Each part's tree travels to the tasks that search
it, and each pair of parts is one cell of bounded size, so a hot shard fills many tasks. Trees
travel by shuffle, to their own shard's fingerprints only: broadcasting each tree to every task
would take the fingerprints of all documents through the driver.

A cell returns links that connect what it found linked, not every pair. Components are then found
by alternating large-star and small-star rounds, each written to the shared folder.

Defined results: null and empty texts have no words and fingerprint zero; a component's id is its
smallest non-null doc_id (null if it has none); repeated rows come back as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import folders
from ..sources.scratch import scratch_folder
from .batches import made_columns, numbered

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in one tree, and probes searched together in it.
PART = 8_192
PROBES = 512
#: Blocks that two near fingerprints agree in: 15 shards a fingerprint, of 20 bits or more, at a radius of 4.
AGREED = 2


def fingerprint(text: str | None) -> int:
    """SimHash of the shingles of four words, as a signed 64-bit number."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(SHINGLE, len(words)) - 1
    hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k:])]  # noqa: B905
    n = len(hashed)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(np.array(hashed[i : i + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprint(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return made_columns(documents, [text], "fingerprint long", lambda texts: [[fingerprint(t) for t in texts]], keep)


# -- shards --------------------------------------------------------------------------


def shard_keys(fingerprints: np.ndarray, radius: int = RADIUS, agreed: int = AGREED) -> np.ndarray:
    """One row per fingerprint, one column per choice of blocks: the bits there, all else zero."""
    blocks = radius + agreed
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]  # noqa: B905
    chosen = [sum(c) for c in combinations(masks, agreed)]
    return fingerprints.view(np.uint64)[:, None] & np.array(chosen, np.uint64)[None, :]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def build_trees(points: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of groups of distinct points. ``group``: ascending.

    Returns for each point: first child's place in ``order``, number of children, distance to the
    parent; and ``order``, which lists the children of a node side by side by that distance.
    """
    n = len(points)
    root = np.searchsorted(group, group, "left")
    parent, distance = root.copy(), np.zeros(n, np.int64)
    todo = np.flatnonzero(root != np.arange(n))
    while len(todo):
        distance[todo] = _bits(points[todo] ^ points[parent[todo]])
        key = parent[todo] * 65 + distance[todo]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        child = todo[first][which]  # the first of those with this distance becomes the child
        settled = child == todo
        parent[todo[~settled]] = child[~settled]
        todo = todo[~settled]
    others = np.flatnonzero(root != np.arange(n))
    order = others[np.lexsort((distance[others], parent[others]))]
    count = np.bincount(parent[others], minlength=n)
    return np.cumsum(count) - count, count, distance, order


def search_trees(points: np.ndarray, trees: tuple, probes: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, node) pairs within the radius, following only edges within it."""
    start, count, edge, order = trees
    for at in range(0, len(probes), PROBES):
        p, node = np.arange(at, min(at + PROBES, len(probes))), roots[at : at + PROBES]
        while len(p):
            d = _bits(probes[p] ^ points[node])
            near = d <= radius
            yield p[near], node[near]
            n = count[node]
            total = int(n.sum())
            child = order[np.repeat(start[node] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.empty(0, np.int64)
            p, d = np.repeat(p, n), np.repeat(d, n)
            follow = np.abs(edge[child] - d) <= radius
            p, node = p[follow], child[follow]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each place, when the links (a, b) are added."""
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
    return label


def links(fingerprints: DataFrame, folder: str, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most ``radius`` bits apart.

    The shards of every fingerprint are written below ``folder``, which must be shared: their sizes
    and their rows are read from there.
    """

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = shard_keys(f, radius)
            choice = np.broadcast_to(np.arange(keys.shape[1], dtype=np.int32), keys.shape)
            columns = [np.repeat(f, keys.shape[1]), choice.ravel(), keys.view(np.int64).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["f", "choice", "shard"])

    fingerprints.select("fingerprint").mapInArrow(sharded, "f long, choice int, shard long").write.parquet(f"{folder}/shards")
    rows = fingerprints.sparkSession.read.parquet(f"{folder}/shards")
    sizes = rows.groupBy("choice", "shard").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes.withColumn("parts", F.ceil(F.col("n") / part).cast("int")), ["choice", "shard"])
    mine = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")
    # part i meets part j >= i in cell (i, j): as the tree's side (side 0) or as the probes' (side 1)
    tree_in = F.transform(F.sequence("mine", F.col("parts") - 1), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    probe_in = F.transform(F.sequence(F.lit(0), F.col("mine")), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side")))
    probe_in = F.filter(probe_in, lambda c: c["i"] != c["j"])
    cells = rows.withColumn("mine", mine).select("choice", "shard", "f", F.explode(F.concat(tree_in, probe_in)).alias("c"))
    cells = cells.select(F.xxhash64("choice", "shard", "c.i", "c.j").alias("cell"), "choice", "shard", "c.i", "c.j", "c.side", "f")
    order = ["cell", "choice", "shard", "i", "j", "side", "f"]
    cells = cells.repartition("cell").sortWithinPartitions(*order)
    return cells.mapInArrow(lambda batches: _link_cells(batches, radius), "a long, b long")


def _link_cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Cells arrive one after the other; the last one of a batch waits for the next batch."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:5]:
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        yield from _linked([c[:cut] for c in columns], new[:cut], radius)
        rest = [c[cut:] for c in columns]
    if rest is not None:
        new = np.zeros(len(rest[0]), bool)
        yield from _linked(rest, new, radius)


def _linked(columns: list[np.ndarray], new: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    f, side = columns[6].view(np.uint64), columns[5]
    if len(f) < 2:
        return
    group = np.cumsum(new)
    nodes, seekers = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    seekers = seekers[np.isin(group[seekers], group[nodes])]  # hashing may leave a part empty
    if not len(nodes):
        return
    # what is near the first node of its cell is linked by that, however many pairs it makes
    both = np.sort(np.concatenate([nodes, seekers]))
    first = nodes[np.searchsorted(group[nodes], group[both], "left")]
    near = np.zeros(len(f), bool)
    near[both] = _bits(f[both] ^ f[first]) <= radius
    label = np.arange(len(f))
    label[both[near[both]]] = first[near[both]]
    far = nodes[~near[nodes]]
    # cells of one part hold only nodes, which search their own tree
    whole = np.bincount(group[seekers], minlength=group[-1] + 1)[group[nodes]] == 0
    others = np.concatenate([nodes[whole & ~near[nodes]], seekers[~near[seekers]]])
    linked = seekers[near[seekers]]
    for own, probes in ((nodes, others), (far, linked[np.isin(group[linked], group[far])])):
        if not len(own) or not len(probes):
            continue
        trees = build_trees(f[own], group[own])
        roots = np.searchsorted(group[own], group[probes], "left")
        for p, node in search_trees(f[own], trees, f[probes], roots, radius):
            a, b = probes[p], own[node]
            if (label[a] != label[b]).any():
                label = join_labels(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(f)))
    yield pa.RecordBatch.from_arrays([pa.array(f[linked].view(np.int64)), pa.array(f[label[linked]].view(np.int64))], names=["a", "b"])


# -- components ----------------------------------------------------------------------


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) of every node of the links (a, b); label is the smallest node of its component.

    Rounds of large-star and small-star end when a round changes nothing. Each is written below
    ``folder``, which must be shared. Stars with very many nodes are sums and joins, never lists.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges.where("a <> b").select(high, low).distinct().write.parquet(f"{folder}/round-0")
    current, seen = spark.read.parquet(f"{folder}/round-0"), None
    for turn in range(1, 200):
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the smallest of its neighbours and itself
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().write.parquet(f"{folder}/round-{turn}")
        current = spark.read.parquet(f"{folder}/round-{turn}")
        folders.remove(spark, f"{folder}/round-{turn - 1}")
    else:
        raise RuntimeError("components did not settle in 200 rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def classes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of every row, and (fingerprint, label, component_id) of every fingerprint."""
    spark, folder = documents.sparkSession, scratch_folder(documents.sparkSession)
    given = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with_fingerprint(given, keep=["doc_id"]).write.parquet(f"{folder}/fingerprints")
    rows = spark.read.parquet(f"{folder}/fingerprints")
    rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    labels = components(links(distinct, folder, radius), f"{folder}/components").select(F.col("node").alias("fingerprint"), "label")
    folders.remove(spark, f"{folder}/shards")
    label = F.coalesce("label", "fingerprint")
    found = distinct.join(labels, "fingerprint", "left").select("fingerprint", "first_id", label.alias("label"))
    ids = found.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows, found.join(ids, "label").select("fingerprint", "label", "component_id")


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable."""
    rows, found = classes(documents, text, doc_id, radius)
    return rows.join(found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its own columns: that with the smallest doc_id.

    Rows that share their doc_id, or have none, are told apart by their fingerprints, so that of
    repeated rows one stays.
    """
    documents, names, back = numbered(documents)
    given = F.col(names[doc_id])
    rows, found = classes(documents, names[text], names[doc_id], radius)
    rows = rows.join(found, "fingerprint").select("doc_id", "fingerprint", "label")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "fingerprint")
    best = rows.groupBy("label").agg(F.min(rank).alias("best")).select("label", "best.doc_id", "best.fingerprint")
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared_id"))
    dropped = rows.join(best, ["label", "doc_id", "fingerprint"], "left_anti").select(F.col("doc_id").alias("dropped_id"))
    if shared.isEmpty():
        return documents.join(dropped, given == F.col("dropped_id"), "left_anti").select(*back)
    alone = documents.join(dropped.unionByName(shared.select(F.col("shared_id").alias("dropped_id"))), given.eqNullSafe(F.col("dropped_id")), "left_anti")
    several = documents.join(shared, given.eqNullSafe(F.col("shared_id")), "left_semi")
    marked = with_fingerprint(several, names[text]).withColumnRenamed("fingerprint", "row_print")
    match = given.eqNullSafe(F.col("doc_id")) & (F.col("row_print") == F.col("fingerprint"))
    chosen = marked.join(best, match, "left_semi").dropDuplicates([names[doc_id], "row_print"])
    return alone.unionByName(chosen.drop("row_print")).select(*back)
