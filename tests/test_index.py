from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphloom.operators.embed import KeywordEmbedder
from glyphloom.plans import find as finding
from glyphloom.plans import update
from glyphloom.plans.build import IndexOptions, build_index
from glyphloom.plans.update import apply_changes, update_index
from glyphloom.schema import CHUNK
from glyphloom.sources import folders
from glyphloom.sources import index as stored_index
from glyphloom.sources import scratch
from glyphloom.sources import tree as tree_source
from glyphloom.sources.index import ConcurrentWriteError, compact_index, latest_version, open_index, read_version, vacuum, versions, write_index
from glyphloom.sources.scratch import release_scratch
from glyphloom.sources.tables import files_from_table
from glyphloom.sources.tree import list_tree, read_tree, scan_tree
from glyphloom.streaming.updates import stream_update

MODEL = KeywordEmbedder(["sort", "database", "network", "math"])
START = {
    "sort.py": ("def sorter(x):\n    return sorted(x)\n", 1.0),
    "db.py": ("class Database:\n    def query(self):\n        pass\n", 1.0),
    "net.go": ("network\nnetwork\nnetwork\n", 1.0),
    "empty.py": ("", 1.0),
}


@pytest.fixture
def files(spark):
    def make(contents):
        rows = [(p, bytearray(c if isinstance(c, bytes) else c.encode()), m) for p, (c, m) in contents.items()]
        return files_from_table(spark.createDataFrame(rows, "file_path string, content binary, mtime double"))

    return make


@pytest.fixture
def built(spark, files, tmp_path):
    return build_index(spark, str(tmp_path / "index"), files(START), MODEL, source="here").index


def state(index):
    """Everything but versions: snippets with vectors, and the manifest."""
    snippets = sorted((r["id"], r["file_path"], r["start_line"], r["content"], tuple(r["embedding"])) for r in index.stored().collect())
    return snippets, sorted(tuple(r) for r in index.manifest().collect())


def names(index):
    return sorted(r["name"] or r["file_path"] for r in index.snippets().collect())


def test_build(spark, files, built):
    assert names(built) == ["Database", "Database.query", "net.go", "sorter"]
    assert built.files == 4 and built.meta == {"model_name": MODEL.name, "source_directory": "here"}
    assert sorted(tuple(r) for r in built.meta_frame().collect()) == sorted(built.meta.items())
    assert finding.count_snippets(built).first()[0] == 4
    order = [(r["file_path"], r["start_line"], r["kind"]) for r in finding.list_snippets(built).collect()]
    assert order == [("db.py", 1, "class"), ("db.py", 2, "method"), ("net.go", 1, "block"), ("sort.py", 1, "function")]
    assert open_index(spark, built.path).version == built.version == 1


def test_build_replaces_and_counts(spark, files, built):
    change = build_index(spark, built.path, files({"a.py": ("x\n", 1.0), "b.bin": ("x", 1.0), "c.py": (b"\x00", 1.0), "d.py": ("", 1.0)}), MODEL)
    assert [tuple(r) for r in change.summary.collect()] == [(2, 1)]
    assert names(open_index(spark, built.path)) == ["a.py"]


def test_missing_index(spark, files, tmp_path):
    for call in (open_index, lambda s, p: update_index(s, p, files(START))):
        with pytest.raises(FileNotFoundError):
            call(spark, str(tmp_path / "nowhere"))
    assert latest_version(spark, str(tmp_path / "nowhere")).version == 0


def test_empty_index(spark, files, tmp_path):
    index = build_index(spark, str(tmp_path / "i"), files(START).where("false"), MODEL).index
    assert finding.find(index, "sort").collect() == [] and index.manifest().collect() == []
    change = update_index(spark, index.path, files(START))
    assert change.summary.first()["added"] == 4 and len(names(change.index)) == 4


def test_options(spark, files, tmp_path):
    options = IndexOptions(languages=["python"], ignore_patterns=["db*"], id_length=64)
    index = build_index(spark, str(tmp_path / "i"), files(START), MODEL, options).index
    assert names(index) == ["sorter"] and len(index.snippets().first()["id"]) == 64


def later():
    return START | {
        "sort.py": ("def sorter(x):\n    return sorted(x)\n", 2.0),
        "db.py": ("class Store:\n    pass\n", 2.0),
        "new.py": ("def math(): pass\n", 1.0),
        "empty.py": (b"\x00", 2.0),
    }


def test_update_equals_a_new_build(spark, files, built, tmp_path):
    after = later() | {"empty.py": ("", 1.0)}
    del after["net.go"]
    change = update_index(spark, built.path, files(after))
    assert change.summary.first().asDict() == {"added": 1, "changed": 1, "removed": 1, "unchanged": 2, "snippets_indexed": 2}
    fresh = build_index(spark, str(tmp_path / "fresh"), files(after), MODEL).index
    assert state(change.index) == state(fresh) == state(open_index(spark, built.path))
    assert change.index.files == 4


def test_update_reads_only_files_whose_mtime_moved(spark, files, built):
    seen = spark.sparkContext.accumulator(0)

    def read(listed):
        rows = [(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, (c, _) in later().items()]
        contents = spark.createDataFrame(rows, "file_path string, content binary")
        seen.add(listed.count())
        return listed.join(contents, "file_path")

    listed = files(later()).drop("content")
    change = update_index(spark, built.path, listed, read_content=read)
    assert seen.value == 4  # sort, db, new and empty, each read once
    assert change.summary.first()["unchanged"] == 2


def test_file_that_turned_binary_keeps_its_snippets(spark, files, built):
    change = update_index(spark, built.path, files(START | {"sort.py": (b"a\x00", 2.0)}))
    assert "sorter" in names(change.index)
    assert change.summary.first().asDict() == {"added": 0, "changed": 0, "removed": 0, "unchanged": 3, "snippets_indexed": 0}
    assert ("sort.py", 1.0) in [(p, m) for p, m, _ in state(change.index)[1]]


def test_touch_is_remembered_and_same_mtime_is_trusted(spark, files, built):
    update_index(spark, built.path, files(START | {"sort.py": (START["sort.py"][0], 2.0)}))
    again = update_index(spark, built.path, files(START | {"sort.py": ("unseen = 1\n", 2.0)}))
    assert again.summary.first().asDict() == {"added": 0, "changed": 0, "removed": 0, "unchanged": 4, "snippets_indexed": 0}
    assert "sorter" in names(again.index)


def test_excluded_files_are_removed(spark, files, built):
    change = update_index(spark, built.path, files(START), options=IndexOptions(languages=["go"]))
    assert names(change.index) == ["net.go"] and change.summary.first()["removed"] == 3


def test_model_must_match(spark, files, built):
    with pytest.raises(ValueError, match="holds vectors"):
        update_index(spark, built.path, files(START), KeywordEmbedder(["other"]))


def test_remove_and_return(spark, files, built):
    rest = {p: c for p, c in START.items() if p != "sort.py"}
    first = update_index(spark, built.path, files(rest)).index
    assert "sorter" not in names(first)
    second = update_index(spark, built.path, files(START)).index
    assert state(second) == state(built)
    assert names(built) == names(second)  # the first version can still be read


def test_compaction(spark, files, built):
    index = update_index(spark, built.path, files(later()), options=IndexOptions(max_logged_share=100.0)).index
    assert len(index.generations) == 2 and index.generations[:1] == built.generations
    compacted = compact_index(spark, built.path)
    assert len(compacted.generations) == 1 and state(compacted) == state(index)
    assert compact_index(spark, built.path) == compacted
    options = IndexOptions(max_generations=1, max_logged_share=100.0)
    index = update_index(spark, built.path, files(START | {"more.py": ("x\n", 1.0)}), options=options).index
    assert len(index.generations) == 1 and "more.py" in names(index)


def leftovers(spark, index):
    """What writers leave that were lost at any point: tables, working tables, drafts of a commit."""
    rows = index.generation_snippets(index.generations[0]).withColumn("name", F.lit("junk"))
    for name in ("2-lost", "9-lost"):
        index.write_files(name, index.file_log(index.generations[0]))
        index.write_snippets(name, rows)
    rows.write.parquet(f"{index.staging()}/texts")
    for name in ("_draft-1", "2.tmp"):
        with open(f"{index.path}/commits/{name}", "w") as f:
            f.write('{"generations"')
    os.makedirs(f"{index.path}/commits/version=2/_temporary")


def test_lost_attempts_are_neither_seen_nor_in_the_way(spark, files, built):
    leftovers(spark, built)
    assert state(open_index(spark, built.path)) == state(built)
    index = update_index(spark, built.path, files(later())).index
    assert "junk" not in names(index) and index.version > 1
    vacuum(spark, built.path)
    assert state(open_index(spark, built.path)) == state(index)
    assert not os.path.exists(f"{built.path}/staged")
    assert {n.removeprefix("generation=") for n in os.listdir(f"{built.path}/files")} == set(index.generations)
    assert versions(spark, built.path) == [index.version]


def test_vacuum_keeps_versions(spark, files, built):
    index = update_index(spark, built.path, files(START | {"more.py": ("x\n", 1.0)})).index
    vacuum(spark, built.path, keep=2)
    assert state(read_version(spark, built.path, 1)) == state(built) and index.version == 2


@pytest.mark.parametrize("store", ["rename", "put"])
def test_of_two_writers_one_commits(spark, files, built, tmp_path, monkeypatch, store):
    if store == "put":  # as on a store without atomic rename
        monkeypatch.setattr(folders, "OBJECT_STORES", {"file"})
        monkeypatch.setattr(folders, "_rename_draft", None)
    other = open_index(spark, built.path)
    index = update_index(spark, built.path, files(later())).index
    after = state(index)
    # the other one started from version 1 as well
    generation = other.new_generation()
    other.write_files(generation, other.file_log(other.generations[0]))
    other.write_snippets(generation, other.generation_snippets(other.generations[0]).where("false"))
    with pytest.raises(ConcurrentWriteError):
        other.commit_whole(generation, 0, None, {})
    assert state(open_index(spark, built.path)) == after
    assert update_index(spark, built.path, files(later())).summary.first()["unchanged"] == index.files - 1
    assert not [x for x in os.listdir(f"{built.path}/commits") if not x.strip(".").removesuffix(".crc").isdigit()]


def test_build_reads_each_content_once(spark, files, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(content: pd.Series) -> pd.Series:
        read.add(len(content))
        return content

    given = files({f"d{i % 5}/f{i}.py": (f"def f{i}(): pass\n" if i % 4 else "", 1.0) for i in range(40)})
    once = lambda listed: listed.withColumn("content", F.pandas_udf(counted, "binary")("content"))
    change = build_index(spark, str(tmp_path / "i"), given, MODEL, read_content=once)
    assert read.value == 40
    assert [tuple(r) for r in change.summary.collect()] == [(40, 30)] and change.index.files == 40
    assert change.index.manifest().where("content_hash IS NULL OR mtime IS NULL").count() == 0
    assert change.index.manifest().count() == 40 and change.index.snippets().count() == 30


def exchanges_above_snippets(frame):
    """Names of the shuffles between a scan of snippets and the result."""
    found, path = [], []
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        path = [(d, x) for d, x in path if d < depth] + [(depth, line)]
        if "snippets/generation=" in line:
            found += [x for _, x in path if "Exchange" in x]
    return found


def test_reading_never_shuffles_snippets(spark, files, tmp_path):
    many = {f"f{i}.py": (f"def f{i}():\n    pass\n\ndef g{i}():\n    pass\n", 1.0) for i in range(30)}
    keep = IndexOptions(max_logged_share=100.0)
    index = build_index(spark, str(tmp_path / "i"), files(many).repartition(4), MODEL).index
    for turn in (2.0, 3.0):
        many |= {f"f{i}.py": (f"def f{i}_{int(turn)}(): pass\n", turn) for i in range(int(turn), 30, 7)}
        many.pop(f"f{int(turn) * 10}.py", None) if turn == 2.0 else many.pop("f0.py")
        index = update_index(spark, index.path, files(many), options=keep).index
    assert len(index.generations) == 3 and index.deleted_bytes > 0
    fresh = build_index(spark, str(tmp_path / "fresh"), files(many), MODEL).index
    assert state(index) == state(fresh)
    for rows in (index.stored(), index.stored(broadcast_bytes=index.deleted_bytes // 2)):
        assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in fresh.stored().collect())
        assert exchanges_above_snippets(rows) == []
        assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def scanned(frame):
    """(data files, bytes) that a scan opens."""
    run = frame._jdf.queryExecution()
    run.toRdd().count()
    leaf = run.executedPlan().collectLeaves().head()
    return tuple(leaf.metrics().apply(m).value() for m in ("numFiles", "filesSize"))


def test_texts_are_stored_small(spark, built):
    """What holds texts is written in the denser codec, which counts most for an update's working tables."""
    import pyarrow.parquet as pq

    parts = [os.path.join(d, f) for d, _, fs in os.walk(f"{built.path}/snippets") for f in fs if f.endswith(".parquet")]
    assert parts
    for part in parts:
        groups = pq.ParquetFile(part).metadata
        assert {groups.row_group(0).column(i).compression for i in range(groups.num_columns)} == {"ZSTD"}


def test_an_update_opens_only_data_files_that_changed(spark, tmp_path, monkeypatch):
    """Scattered paths and mtimes: neither tells the data files apart, their names do."""
    rows = [(f"f{i}.py", f"def f{i}(): pass\n".encode(), float(i * 7919 % 1000)) for i in range(400)]
    table = spark.createDataFrame(rows, "path string, bytes binary, time double").repartition(40, "path")
    table.write.parquet(str(tmp_path / "files"))
    moved = ["f17.py", "f205.py", "f399.py"]
    found, inner = [], update.in_data_files

    def kept(files, of):
        found.append(inner(files, of))
        return found[-1]

    monkeypatch.setattr(update, "in_data_files", kept)
    monkeypatch.setattr(update, "PATH_LITERALS", 0)
    read = lambda: files_from_table(spark.read.parquet(str(tmp_path / "files")), "path", "bytes", "time")
    now = lambda: read().withColumn("mtime", F.col("mtime") + F.col("file_path").isin(moved).cast("int") * 5000)
    index = build_index(spark, str(tmp_path / "i"), read(), MODEL).index
    change = update_index(spark, index.path, now())
    assert change.summary.first().asDict() == {"added": 0, "changed": 0, "removed": 0, "unchanged": 400, "snippets_indexed": 0}
    assert [r["mtime"] for r in change.index.manifest().where(F.col("file_path") == "f17.py").collect()] == [17 * 7919 % 1000 + 5000.0]
    opened, whole = scanned(found[0]), scanned(read())
    assert whole[0] > 30 and opened[0] <= 3 and opened[1] < whole[1] / 8
    assert state(change.index) == state(build_index(spark, str(tmp_path / "fresh"), now(), MODEL).index)


def test_data_files_are_used_where_they_are_known(spark, tmp_path, monkeypatch):
    spark.range(20).select(F.col("id").alias("x")).repartition(4).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    places = table.select("x", *update.located(table))
    one = places.where("x = 7")
    assert scanned(update.in_data_files(table, one))[0] == 1
    assert update.in_data_files(table, one.drop("data_file")) is table
    assert update.in_data_files(table, one.withColumn("data_file", F.lit(None).cast("string"))) is table
    assert update.in_data_files(table, places.where("false")).count() == 0
    monkeypatch.setattr(update, "DATA_FILES", 2)
    assert update.in_data_files(table, places) is table
    # neither joined rows nor a column of that name are places
    assert update.located(table.union(table)) == [] == update.located(table.withColumn("_metadata", F.lit(1)))


def test_bitmaps_span_chunks(spark, tmp_path):
    """Files of many snippets, replaced one by one, across chunks of rows and data files."""
    n = CHUNK + 200
    stored = spark.range(n + 300).select(
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") < n, "big.go").otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"), F.lit(".go"))).alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("block").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit("go").alias("language"), F.lit("x").alias("content"), F.lit(0).alias("ordinal"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
    ).repartition(3)
    manifest = spark.createDataFrame([(p, 1.0, "h") for p in ("big.go", "s0.go", "s1.go", "s2.go")], "file_path string, mtime double, content_hash string")
    index = write_index(spark, str(tmp_path / "i"), stored, manifest, {"model_name": "keyword:x", "source_directory": ""})
    keep = IndexOptions(max_logged_share=100.0)
    for i, (gone, left) in enumerate((("s1.go", n + 200), ("big.go", 200), ("s2.go", 100))):
        rows = spark.createDataFrame([(gone, None, 2.0 + i, 0, True)], CHANGES)
        index = apply_changes(spark, index.path, rows, options=keep).index
        assert index.snippets().count() == left
    assert {r["file_path"] for r in index.snippets().collect()} == {"s0.go"}


def test_a_batch_opens_only_its_buckets(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "BUCKET_FILES", 5)
    opened = {}
    for n in (20, 60):
        index = build_index(spark, str(tmp_path / f"i{n}"), files({f"f{i}.py": (f"x{i} = 1\n", 1.0) for i in range(n)}), MODEL).index
        assert index.buckets == n // 5 and len(os.listdir(f"{index.path}/files/generation={index.generations[0]}")) > n // 10
        read = []
        logs = stored_index.SnippetIndex._logs

        def counted(self, generations, buckets=None, logs=logs, read=read):
            rows = logs(self, generations, buckets)
            read.extend(rows.inputFiles() if buckets is not None or generations[-1] in index.generations else [])  # noqa: B023
            return rows

        monkeypatch.setattr(stored_index.SnippetIndex, "_logs", counted)
        after = changed(spark, index.path, ("f7.py", b"y = 2\n", 2.0, False), ("new.py", b"z = 1\n", 2.0, False), options=IndexOptions(max_logged_share=100.0))
        monkeypatch.setattr(stored_index.SnippetIndex, "_logs", logs)
        opened[n] = len({f for f in read if f.endswith(".parquet")})
        assert after.files == n + 1 and after.snippets().count() == n + 1
    assert opened[60] <= opened[20] <= 4


def test_vectors_of_another_width_are_refused(spark, files, built, tmp_path):
    class Uneven(KeywordEmbedder):
        def as_column(self, text, batch_size=32):
            even = super().as_column(text, batch_size)
            return F.when(F.contains(text, F.lit("sorter")), F.slice(even, 1, 2)).otherwise(even)

    with pytest.raises(ValueError, match="widths 2 to 4"):
        build_index(spark, str(tmp_path / "uneven"), files(START), Uneven(MODEL.vocabulary))
    assert versions(spark, str(tmp_path / "uneven")) == []

    class Narrow(KeywordEmbedder):
        def as_column(self, text, batch_size=32):
            return F.slice(super().as_column(text, batch_size), 1, 2)

    before = state(built)
    with pytest.raises(ValueError, match="index holds 4"):
        update_index(spark, built.path, files(later()), Narrow(MODEL.vocabulary))
    assert state(open_index(spark, built.path)) == before and versions(spark, built.path) == [1]
    assert build_index(spark, built.path, files(START), KeywordEmbedder(["a", "b"])).index.width == 2


def test_nothing_is_left_behind(spark, files, built):
    release_scratch()
    index = update_index(spark, built.path, files(START | {"db.py": ("x = 1\n", 2.0)}), options=IndexOptions(max_logged_share=100.0)).index
    changed(spark, built.path, ("feed.py", b"y = 1\n", 2.0, False), options=IndexOptions(max_logged_share=100.0))
    assert finding.find(index, ["sort", "network"], 2).count() == 4
    assert not os.path.exists(f"{built.path}/staged") or os.listdir(f"{built.path}/staged") == []
    assert scratch._made == []
    asked = spark.createDataFrame([(1, "sort")], "query_id long, text string")
    assert finding.find(index, asked, 1).count() == 1
    (folder,) = (str(place.toUri().getPath()) for place, _ in scratch._made)
    assert os.path.exists(folder)
    release_scratch()
    assert not os.path.exists(folder)


def test_find_and_show(spark, built):
    found = finding.find(built, ["Sort things", "a DATABASE"], 1).orderBy("query_id").collect()
    assert [(r["query_id"], r["rank"], r["name"]) for r in found] == [(0, 1, "sorter"), (1, 1, "Database")]
    assert found[0]["header"] == f"1. [1.000] function sorter  (sort.py:1)  id={found[0]['id']}"
    assert found[0]["preview"] == "    def sorter(x):\n        return sorted(x)"
    assert len(finding.find(built, "network", 50).collect()) == 4
    assert finding.find(built, "network", 0).collect() == []
    shown = finding.show(built, found[0]["id"]).first()
    assert (shown["name"], shown["title"]) == ("sorter", "function sorter")
    assert shown["subtitle"] == f"sort.py:1-2  id={found[0]['id']}"
    assert finding.show(built, "absent").collect() == []


def test_find_many(spark, built, monkeypatch):
    """Beyond the point look-ups the hits are joined."""
    some = finding.find(built, ["sort", "math"], 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(finding, "_POINT_LOOKUPS", 1)
    assert finding.find(built, ["sort", "math"], 3).orderBy("query_id", "rank").collect() == some


CHANGES = "file_path string, content binary, mtime double, size long, deleted boolean"


def test_apply_changes(spark, built):
    rows = [
        ("sort.py", bytearray(b"old = 1\n"), 2.0, 8, False),
        ("sort.py", bytearray(b"new = 1\n"), 3.0, 8, False),
        ("net.go", None, 2.0, 0, True),
        ("never.py", None, 2.0, 0, True),
        ("skip.txt", bytearray(b"x"), 2.0, 1, False),
        ("add.py", bytearray(b"def added(): pass\n"), 2.0, 18, False),
    ]
    change = apply_changes(spark, built.path, spark.createDataFrame(rows, CHANGES))
    assert names(change.index) == ["Database", "Database.query", "added", "sort.py"]
    assert change.summary.first().asDict() == {"added": 1, "changed": 1, "removed": 1, "unchanged": 2, "snippets_indexed": 2}


def changed(spark, path, *rows, options=IndexOptions()):
    full = [(p, None if c is None else bytearray(c), m, None if c is None else len(c), d) for p, c, m, d in rows]
    return apply_changes(spark, path, spark.createDataFrame(full, CHANGES), options=options).index


def test_no_change_is_lost(spark, built):
    index = changed(
        spark, built.path,
        ("db.py", None, None, True),  # a deletion without mtime is the last word of its batch
        ("db.py", b"late = 1\n", 9.0, False),
        ("net.go", b"a\nb\nc\n", 3.0, False),
        ("net.go", None, 3.0, True),  # of equal mtimes the deletion counts
        ("sort.py", b"def fresh(): pass\n", 2.0, None),  # null is not deleted
        ("timeless.py", b"def timeless(): pass\n", None, False),
    )
    assert names(index) == ["fresh", "timeless"]
    assert changed(spark, built.path, ("timeless.py", b"def again(): pass\n", None, False)).files == 3
    assert "again" in names(open_index(spark, built.path))


def test_a_file_that_no_longer_passes_is_removed(spark, built):
    small = IndexOptions(max_bytes=20, ignore_patterns=["net*"])
    index = changed(spark, built.path, ("sort.py", b"def sorter(): pass  # much longer now\n", 2.0, False), ("net.go", b"x\n", 2.0, False), options=small)
    assert names(index) == ["Database", "Database.query"] and index.files == 2


def test_older_rows_of_later_batches_change_nothing(spark, built):
    first = changed(spark, built.path, ("sort.py", b"def new(): pass\n", 5.0, False), ("net.go", None, 5.0, True))
    for compacted in (False, True):
        if compacted:
            compact_index(spark, built.path)
        later = changed(
            spark, built.path,
            ("sort.py", b"def old(): pass\n", 4.0, False), ("sort.py", None, 3.0, True), ("net.go", b"x\n", 4.0, False), ("gone.py", None, 6.0, True), ("gone.py", b"x\n", 5.0, False),
        )
        assert state(later) == state(first)
    assert "back.go" not in names(changed(spark, built.path, ("gone.py", b"def gone(): pass\n", 5.5, False)))
    back = changed(spark, built.path, ("net.go", b"n\nn\nn\n", 7.0, False), ("gone.py", b"def gone(): pass\n", 7.0, False))
    assert names(back) == ["Database", "Database.query", "gone", "net.go", "new"]


def test_a_late_row_does_not_bring_a_deleted_file_back(spark, built):
    gone = changed(spark, built.path, ("sort.py", None, None, True))
    assert "sorter" not in names(gone)
    assert "sorter" not in names(changed(spark, built.path, ("sort.py", b"def sorter(): pass\n", 1.0, False)))
    assert "sorter" in names(changed(spark, built.path, ("sort.py", b"def sorter(): pass\n", 1.5, False)))


def test_contents_of_a_batch_are_shuffled_once(spark, built, monkeypatch):
    """The join with the deletions on record shuffled them again; its side is no larger than the batch's paths."""
    changed(spark, built.path, ("net.go", None, 5.0, True))
    plans, apply = [], update._apply

    def noted(index, differs, kept, *rest):
        plans.append(kept._jdf.queryExecution().executedPlan().toString())
        return apply(index, differs, kept, *rest)

    monkeypatch.setattr(update, "_apply", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = changed(spark, built.path, ("net.go", b"late\n", 4.0, False), ("sort.py", b"def new(): pass\n", 2.0, False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert names(after) == ["Database", "Database.query", "new"]
    assert "SortMergeJoin" not in plans[0] and "Exchange hashpartitioning" not in plans[0]


def test_files_without_mtime_are_updated(spark, files, built):
    after = {"sort.py": ("def one(): pass\n", None), "new.py": ("def two(): pass\n", None)}
    assert names(update_index(spark, built.path, files(after)).index) == ["one", "two"]
    after["new.py"] = ("def three(): pass\n", None)
    change = update_index(spark, built.path, files(after))
    assert names(change.index) == ["one", "three"] and change.summary.first()["unchanged"] == 1


def test_stream_in_several_batches(spark, files, built, tmp_path):
    def feed(number, rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed" / f"n={number}"))

    def run(checkpoint, name=None):
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed/*"))
        stream_update(stream, built.path, str(tmp_path / checkpoint)).awaitTermination()
        return open_index(spark, built.path)

    feed(1, [("sort.py", bytearray(b"a = 1\n"), 2.0, 6, False)])
    feed(2, [("net.go", None, 2.0, 0, True), ("add.py", bytearray(b"def added(): pass\n"), 2.0, 18, False)])
    index = run("c")
    assert names(index) == ["Database", "Database.query", "added", "sort.py"]
    version = index.version
    assert run("c").version == version
    feed(3, [("add.py", None, 3.0, 0, True)])
    assert names(run("c")) == ["Database", "Database.query", "sort.py"]
    # another stream starts counting its batches anew and is not taken for a replay
    assert run("other").version > version + 1


def test_replayed_batch_is_skipped(spark, built, tmp_path):
    spark.createDataFrame([("a.py", bytearray(b"x\n"), 2.0, 2, False)], CHANGES).write.parquet(str(tmp_path / "feed"))

    def run():
        stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "feed"))
        stream_update(stream, built.path, str(tmp_path / "c")).awaitTermination()
        return open_index(spark, built.path).version

    version = run()
    for name in os.listdir(tmp_path / "c/commits"):
        os.remove(tmp_path / "c/commits" / name)
    assert run() == version


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    contents = {
        "a.py": b"def sorter(): pass\n", "pkg/__init__.py": b"", "pkg/.hidden.py": b"x\n", "pkg/sub/deep/b.go": b"y\n",
        "node_modules/c.js": b"z\n", ".git/d.py": b"z\n", "big.py": b"x" * 1_000_001, "e.txt": b"x\n",
        "gen/f.py": b"x\n", "pkg/g.gen.py": b"x\n", "bin.py": b"\x00",
    }
    for path, content in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "link.py").symlink_to(root / "a.py")
    (root / "loop").symlink_to(root)
    return root


def test_tree(spark, tree):
    def listed(**filters):
        return sorted(r["file_path"] for r in list_tree(spark, str(tree), **filters).collect())

    assert listed() == ["a.py", "bin.py", "gen/f.py", "pkg/.hidden.py", "pkg/__init__.py", "pkg/g.gen.py", "pkg/sub/deep/b.go"]
    assert listed(ignore_patterns=["gen/", "*.gen.py"], languages=["python"]) == ["a.py", "bin.py", "pkg/.hidden.py", "pkg/__init__.py"]
    assert listed(extensions={".txt": "text"}) == ["e.txt"]
    assert "node_modules/c.js" in listed(ignore_dirs=[])
    assert "big.py" in listed(max_bytes=2_000_000)
    rows = {r["file_path"]: bytes(r["content"]) for r in scan_tree(spark, f"file://{tree}").collect()}
    assert rows["a.py"] == b"def sorter(): pass\n" and rows["pkg/__init__.py"] == b"" and len(rows) == 7
    assert list_tree(spark, str(tree)).first()["mtime"] == pytest.approx(os.stat(tree / "a.py").st_mtime, abs=60)
    with pytest.raises(NotADirectoryError):
        list_tree(spark, str(tree / "absent"))


def test_a_deep_branch_is_listed_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree_source, "FIRST_FOLDERS", 3)
    folder, want = tmp_path / "only", set()
    for depth in range(12):
        folder = folder / f"d{depth}"
        for side in range(9):
            (folder / f"s{side}" / "x").mkdir(parents=True)
            (folder / f"s{side}" / "x" / f"f{depth}.py").write_text("x = 1\n")
            want.add(os.path.relpath(folder / f"s{side}" / "x" / f"f{depth}.py", tmp_path))
    (folder / ".hidden").mkdir()
    (folder / ".hidden" / "no.py").write_text("x = 1\n")
    os.symlink(tmp_path / "only", folder / "loop")
    (folder / os.fsdecode(b"\xff")).mkdir()
    listed = list_tree(spark, str(tmp_path))
    assert sorted(r["file_path"] for r in listed.collect()) == sorted(want)
    rounds = listed.select(F.regexp_extract(F.input_file_name(), "round-[0-9]+/part-[0-9]+", 0).alias("task")).distinct()
    tasks = [r["task"] for r in rounds.collect()]
    assert len({x.split("/")[0] for x in tasks}) > 2
    assert len(tasks) >= 8


def test_a_tree_without_files(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).collect() == []


def test_unreadable_file_drops_out(spark, tree):
    files = list_tree(spark, str(tree)).collect()
    listed = spark.createDataFrame(files)
    (tree / "a.py").unlink()
    contents = {r["file_path"]: r["content"] for r in read_tree(listed, str(tree)).collect()}
    assert contents["a.py"] is None and bytes(contents["gen/f.py"]) == b"x\n"


def test_tree_build_and_update(spark, tree, tmp_path):
    def read(listed):
        return read_tree(listed, str(tree))

    path = str(tmp_path / "i")
    change = build_index(spark, path, list_tree(spark, str(tree)), MODEL, read_content=read, source=str(tree))
    assert [tuple(r) for r in change.summary.collect()] == [(6, 5)]
    (tree / "a.py").write_text("def other(): pass\n")
    os.utime(tree / "a.py", (5, 5))
    os.utime(tree / "gen/f.py", (5, 5))
    (tree / "pkg/g.gen.py").unlink()
    (tree / "new.js").write_text("function fresh() {\n}\n")
    change = update_index(spark, path, list_tree(spark, str(tree)), read_content=read)
    assert change.summary.first().asDict() == {"added": 1, "changed": 1, "removed": 1, "unchanged": 4, "snippets_indexed": 2}
    assert {"other", "fresh"} <= set(names(change.index))
