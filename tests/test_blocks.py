from __future__ import annotations

import random

from glyphloom.operators.blocks import split_blocks


def cut(texts, content, **options):
    rows = split_blocks(texts(("f.go", "go", content)), **options).orderBy("ordinal").collect()
    return [(r["start_line"], r["end_line"], r["content"]) for r in rows]


def spans(found):
    return [f[:2] for f in found]


def test_nothing_to_split(texts):
    assert cut(texts, "") == []
    assert cut(texts, " \n\t\n　\n") == []


def test_blocks_and_their_columns(texts):
    row = split_blocks(texts(("f.go", "go", "\na\nb\nc"))).collect()[0]
    assert (row["kind"], row["name"], row["language"], row["file_path"]) == ("block", None, "go", "f.go")
    assert split_blocks(texts(("f.go", "go", "a")).drop("language")).first()["language"] == "generic"
    assert cut(texts, "a\nb\nc\n\n\nd\ne\nf\n") == [(1, 3, "a\nb\nc"), (6, 8, "d\ne\nf")]


def test_small_blocks_join_the_next_or_the_last(texts):
    assert spans(cut(texts, "a\n\nb\nc\nd")) == [(1, 5)]
    assert spans(cut(texts, "a\nb\nc\n\nd\n\ne")) == [(1, 7)]
    assert spans(cut(texts, "a\n\nb\n\nc")) == [(1, 5)]
    # two small blocks of four lines together still go to the block after them
    assert spans(cut(texts, "a\nb\n\nc\nd\n\ne\nf\ng\n\nh\ni\nj")) == [(1, 9), (11, 13)]
    assert spans(cut(texts, "a\n\nb", min_lines=1)) == [(1, 1), (3, 3)]


def test_caps(texts):
    assert spans(cut(texts, "x\n" * 150)) == [(1, 60), (61, 120), (121, 150)]
    assert spans(cut(texts, "x\n" * 10, max_lines=4)) == [(1, 4), (5, 8), (9, 10)]


def model(content, max_lines, min_lines):
    """Blocks by walking over the lines once."""
    lines, found, first = content.splitlines(), [], None
    islands = []
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            first = i if first is None else first
        elif first is not None:
            islands.append((first, i - 1))
            first = None
    open_at = None
    for a, b in islands:
        open_at = a if open_at is None else open_at
        if b - a + 1 >= min_lines:
            found.append([open_at, b])
            open_at = None
    if open_at is not None:
        if found:
            found[-1][1] = islands[-1][1]
        else:
            found.append([open_at, islands[-1][1]])
    pieces = [(p, min(p + max_lines - 1, b)) for a, b in found for p in range(a, b + 1, max_lines)]
    return [(a + 1, b + 1, "\n".join(lines[a : b + 1])) for a, b in pieces]


def test_random_texts_equal_a_line_walk(texts):
    random.seed(11)
    bits = ["a", "b ", "\n", "\n", "\n", "\r\n", "\r", " ", "\x85", "\x1f", "\x0c", "x\ny\nz\n", "　"]
    samples = ["".join(random.choices(bits, k=random.randint(0, 60))) for _ in range(800)]
    files = texts(*[(str(i), "go", s) for i, s in enumerate(samples)])
    for high, low in [(5, 3), (60, 3), (2, 1), (7, 4)]:
        got = {}
        for r in split_blocks(files, max_lines=high, min_lines=low).orderBy("ordinal").collect():
            got.setdefault(int(r["file_path"]), []).append((r["start_line"], r["end_line"], r["content"]))
        assert [got.get(i, []) for i in range(len(samples))] == [model(s, high, low) for s in samples]


def test_plan_has_no_shuffle(texts):
    plan = split_blocks(texts(("f.go", "go", "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
