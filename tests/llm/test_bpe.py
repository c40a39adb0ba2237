from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as f:
        return bpe.Merges(f.read().splitlines(), public_tokenizers.PATTERN)


def same(merges, texts):
    ids, ends = merges.encode(texts)
    for i, t in enumerate(texts):
        got = ids[ends[i] : ends[i + 1]].tolist()
        assert got == LIBRARY.encode_ordinary(t), t[:80]
        assert merges.decode(got) == t.encode()


def test_equals_the_library(merges):
    rng = random.Random(1)
    letters = " aab'stellnrv\n\t.,_-123²Ⅷé́ß漢字😀\x1c\x1f\xa0\x85　  eeooththe"
    same(merges, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)])
    same(merges, ["", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 99, "word " * 20_000, "the", "the", "<|endoftext|>", "0123456789" * 300])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_equals_the_library_on_any_text(merges, texts):
    same(merges, texts)


def test_words_from_earlier_blocks_are_kept_within_a_bound(merges, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    same(merges, ["one two three four five six seven eight"])
    assert len(merges.known) == 5
    same(merges, ["eight seven six five four three two one", "nine"])


def test_low_tokens_merge_one_by_one(merges):
    low = [p for p, r in RANKS.items() if merges.low[r] and p.isalpha()][:300]
    same(merges, [(p * 3).decode("latin-1") for p in low] + [p.decode("latin-1") + "s" + p.decode("latin-1") for p in low])


def test_frame(spark, odd, none):
    ranks = bpe.vocabulary(spark, PATH, public_tokenizers.PATTERN)
    for block in (10, bpe.BLOCK):
        encoded = bpe.with_ids(odd, ranks, block=block)
        rows = encoded.select("doc_id", "text", "ids").collect()
        assert len(rows) == 10 and all(r["ids"] == LIBRARY.encode_ordinary(r["text"] or "") for r in rows)
    digests = {r["doc_id"]: r for r in bpe.digests(encoded, ranks).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    text = "the same words twice over"
    ids = LIBRARY.encode_ordinary(text)
    assert tuple(digests[5]) == (5, len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
    assert tuple(digests[1]) == tuple(digests[2])[:0] + (1, 0, sha(b""), sha(b""))
    assert bpe.digests(bpe.with_ids(none, ranks), ranks).collect() == []
