from __future__ import annotations

from glyphloom.operators import changes, present

FILES = "file_path string, mtime double, content_hash string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_classify_and_removed(spark):
    manifest = spark.createDataFrame(
        [("same", 1.0, "h"), ("touch", 1.0, "h"), ("edit", 1.0, "h"), ("back", 5.0, "h"), ("bin", 1.0, "h"), ("gone", 1.0, "h")],
        FILES,
    )
    files = spark.createDataFrame(
        [("same", 1.0, "other"), ("touch", 2.0, "h"), ("edit", 2.0, "k"), ("back", 4.0, "k"), ("bin", 2.0, None),
         ("new", 1.0, "h"), ("newbin", 1.0, None)],
        FILES,
    )
    assert rows(changes.classify_files(files, manifest)) == [
        ("back", "CHANGED"), ("bin", "SKIPPED"), ("edit", "CHANGED"), ("new", "NEW"), ("newbin", "SKIPPED"),
        ("same", "UNCHANGED"), ("touch", "TOUCHED"),
    ]
    assert rows(changes.removed_files(manifest, files)) == [("gone",)]
    assert rows(changes.file_paths(manifest.union(manifest))) == sorted((p,) for p in ["same", "touch", "edit", "back", "bin", "gone"])


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(changes.upsert(old, new, "k")) == [("a", 1), ("b", 3), ("c", 4)]
    many = spark.createDataFrame([("b", 9, 1), ("b", 5, 2), ("c", None, 3), ("c", 4, 1)], "k string, v int, n int")
    assert [tuple(r) for r in changes.upsert(old, many, "k", "n").orderBy("k").collect()] == [("a", 1), ("b", 5), ("c", None)]


def test_delete_and_count(spark):
    snippets = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, file_path string")
    paths = spark.createDataFrame([("a",), ("zzz",)], "file_path string")
    assert rows(changes.delete_by_file(snippets, paths)) == [("b", "3")]
    assert rows(changes.count_snippets(snippets)) == [(3,)]
    assert rows(changes.build_summary(paths, snippets)) == [(2, 3)]
    assert rows(changes.build_summary(paths, snippets.where("false"))) == [(2, 0)]


def test_update_summary(spark):
    names = ["NEW", "CHANGED", "CHANGED", "REMOVED", "UNCHANGED", "TOUCHED", "SKIPPED"]
    status = spark.createDataFrame([(str(i), s) for i, s in enumerate(names)], "file_path string, status string")
    summary = changes.update_summary(status, spark.range(8)).collect()[0]
    assert summary.asDict() == {"added": 1, "changed": 2, "removed": 1, "unchanged": 2, "snippets_indexed": 8}


def test_hydrate_skips_missing_snippets(spark):
    hits = spark.createDataFrame([(1, 1, "x", 0.5), (1, 2, "gone", 0.4), (1, 3, "y", 0.3)], "query_id int, rank int, id string, score double")
    snippets = spark.createDataFrame(
        [("x", "a.py", 3, "function", "f", "def f(): pass"), ("y", "b.go", 1, "block", None, "q")],
        "id string, file_path string, start_line int, kind string, name string, content string",
    )
    shown = present.format_hits(present.hydrate(hits, snippets)).orderBy("rank").collect()
    assert [r["header"] for r in shown] == ["1. [0.500] function f  (a.py:3)  id=x", "3. [0.300] block  (b.go:1)  id=y"]
    assert [r["preview"] for r in shown] == ["    def f(): pass", "    q"]
