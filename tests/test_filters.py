from __future__ import annotations

import fnmatch
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import paths
from glyphloom.operators import filters
from glyphloom.schema import EXTENSIONS, IGNORED_DIRS


@pytest.fixture
def listed(spark):
    def make(*names, size=10):
        return spark.createDataFrame([(n, size) for n in names], "file_path string, size long")

    return make


def kept(df):
    return sorted(r["file_path"] for r in df.collect())


def test_suffix_equals_pathlib(spark):
    names = [".py", "a.py", "a.", "..py", "a..", "..a.py", "a.b.c", "x/.a.py", "q/r.d/z", "a.PY", "d.e/.f", " .py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r["p"]: r["s"] for r in df.select("p", paths.suffix(F.col("p")).alias("s")).collect()}
    # a name made of dots only up to its suffix differs between Python versions
    assert got == {n: PurePosixPath(n).suffix if n != "..py" else ".py" for n in names}


def test_languages(spark):
    rows = [(f"m/x{s}", lang) for s, lang in EXTENSIONS.items()] + [("m/x.md", None), ("m/X.PY", None), ("py", None)]
    df = spark.createDataFrame(rows, "p string, want string")
    wrong = df.where(~F.equal_null(paths.language_for(F.col("p")), F.col("want")))
    assert wrong.collect() == []
    assert len(EXTENSIONS) == 23 and len(set(EXTENSIONS.values())) == 14


def test_own_extensions(listed):
    files = filters.filter_extensions(listed("a.sql", "b.py"), {".sql": "sql"})
    assert [tuple(r) for r in files.collect()] == [("a.sql", 10, "sql")]
    assert kept(filters.filter_extensions(listed("a.sql"), {})) == []


def test_language_restriction(listed):
    files = listed("a.py", "b.js", "c.mjs", "d.txt")
    assert kept(filters.filter_languages(files, None)) == ["a.py", "b.js", "c.mjs"]
    assert kept(filters.filter_languages(files, ["javascript"])) == ["b.js", "c.mjs"]
    assert kept(filters.filter_languages(files, [])) == []
    assert kept(filters.filter_languages(files, ["cobol"])) == []


def test_ignored_dirs(listed):
    names = ["a.py", ".env.py", "src/.hidden.py", "node_modules/x.js", "src/build/x.py", "src/.git/x.py",
             ".cfg/x.py", "_priv/__init__.py", "build.py", "dist", "rebuild/x.py"]
    want = ["a.py", ".env.py", "src/.hidden.py", "_priv/__init__.py", "build.py", "dist", "rebuild/x.py"]
    assert kept(filters.filter_ignored_dirs(listed(*names))) == sorted(want)
    assert kept(filters.filter_ignored_dirs(listed("build/a.py", "gen/a.py"), ["gen"])) == ["build/a.py"]
    assert len(IGNORED_DIRS) == 27


def test_ignore_patterns(listed):
    files = listed("a.py", "a.gen.py", "t/fix/deep/a.py", "t/b.py", "lib/c.py", "x/lib/d.py", "build/e.py")
    patterns = ["*.gen.py", "t/fix/*", "lib/"]
    assert kept(filters.filter_ignore_patterns(files, patterns)) == ["a.py", "t/b.py"]
    assert kept(filters.filter_ignore_patterns(files, ["x/lib/"])) == kept(filters.filter_ignored_dirs(files))
    assert kept(filters.filter_ignore_patterns(files, None)) == kept(filters.filter_ignored_dirs(files))


def test_globs_equal_fnmatch(spark):
    random.seed(5)
    globs = ["*.py", "a[!b]c", "[]a]x", "[!]a]", "[a", "**x", "[a-c-e]", "[z-a]q", "[!z-a]q", "a.b+c", "[^a]",
             "[a&&b]", "[--0]", "[a-]", "[]", "[!]", "é?", "a[[]b", "[a|b]c", "\\d", "", "x/*"]
    alphabet = "abcxq[]!-&^*.+/py|é\\d\n"
    words = ["".join(random.choices(alphabet, k=random.randint(0, 4))) for _ in range(1500)] + ["a.py\n", "x/y/z"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    tests = [F.col("w").rlike(paths.glob_to_regex(g)) for g in globs]
    for row in df.select("w", F.array(*tests).alias("hits")).collect():
        assert row["hits"] == [fnmatch.fnmatchcase(row["w"], g) for g in globs], row["w"]


def test_size(spark):
    rows = [("a", 0), ("b", 1_000_000), ("c", 1_000_001)]
    files = spark.createDataFrame(rows, "file_path string, size long")
    assert kept(filters.filter_size(files)) == ["a", "b"]
    assert kept(filters.filter_size(files, 0)) == ["a"]


@pytest.mark.parametrize(
    ("path", "root", "below"),
    [
        ("./src/a.py", None, "src/a.py"), ("src//a.py", None, "src/a.py"), ("src/./b/././a.py", None, "src/b/a.py"), ("/home/build/x/b.go", "/home/build/x", "b.go"), ("/home/build/x//b.go", "/home/build//x/", "b.go"),
        ("/other/b.go", "/home", "/other/b.go"), ("/homes/b.go", "/home", "/homes/b.go"), (".hidden/a.py", None, ".hidden/a.py"), ("./x/a.py", "./x", "a.py"), ("/a.py", "/", "a.py"), (None, "/x", None), ("a..b/.c/d", None, "a..b/.c/d"),
    ],
)
def test_relative_path(spark, path, root, below):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(paths.relative_path(F.col("p"), root)).first()[0] == below


def test_null_size_drops_nothing_unseen(spark):
    frame = spark.createDataFrame([("a.py", "x" * 9, None), ("b.py", "x", None), ("c.py", "x", 9)], "file_path string, content string, size long")
    assert [r[0] for r in filters.filter_size(frame, 5).collect()] == ["b.py"]
    assert [r[0] for r in filters.filter_size(frame.drop("content"), 5).collect()] == ["a.py", "b.py"]


def test_one_condition_equals_the_filters(spark):
    rows = [(p, 1) for p in ["a.py", "x/a.py", ".git/a.py", "b.go", "lib/c.py", "d.test.py", "e.txt", None]]
    frame = spark.createDataFrame(rows, "file_path string, size long")
    given = {"languages": ["python"], "ignore_patterns": ["lib/", "*.test.*"]}
    kept = filters.indexable_files(frame, **given).select("file_path").collect()
    assert frame.where(filters.passes_path(F.col("file_path"), **given)).select("file_path").collect() == kept
