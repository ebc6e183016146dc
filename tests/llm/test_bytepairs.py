"""Byte-level encoding by segment trees against the library."""

import hashlib
import random

import numpy as np
import pytest

from fathomline.llm import bytepairs
from tests.llm.test_texts import documents

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", " \n a", "don't I'LL ''s '''ve", "x<|endoftext|>y", "\x00\x1c a\x1c\x1db \x85c", "你好 123 4.5٣", "ÀÉß&&& %%%*** A&B", "𝒜𝒷 🤖🤖 𐐀", "Ᲊa \U0001e5d0",
       "ab" * 9000, "don't" * 30_000, "é́" * 5000, ("word, " * 9000), "  " * 50_000, "a1" * 60_000, "!?" * 40_000, "x" * 150_000]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytepairs.vocabulary(PATH).ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_both_trees_merge_the_leftmost_least_pair(library):
    v, rng = bytepairs.vocabulary(PATH), random.Random(3)

    def plain(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            ranks = [v.ranks.get(a + b, bytepairs.NONE) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == bytepairs.NONE:
                return [v.ranks[p] for p in parts]
            i = ranks.index(min(ranks))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    pieces = [bytes(rng.choices(rng.choice([b"ab", b"ethansio", bytes(range(256))]), k=rng.randint(1, 120))) for _ in range(600)]
    for p, row in zip(pieces, v.merged_rows(pieces)):
        assert plain(p) == v.merged(p) == ids(row), p


def test_splits_and_parts_of_any_characters(library):
    s, e, rng = bytepairs.splitter(P.PATTERN), bytepairs.Encoder(PATH, P.PATTERN), random.Random(5)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(p + chr(c) for c in codes[i:i + 997]) for i in range(0, len(codes), 997) for p in "a1! "]
    for _ in range(3000):
        most = rng.choice([0x80, 0x300, 0x3000, len(codes)])
        texts.append("".join(chr(codes[rng.randrange(most)]) if rng.random() < 0.5 else rng.choice("  \n'aslltvreé1!\x1c\x85") for _ in range(rng.randint(0, 60))))
    for t, raw in zip(texts, e.encode(texts)):
        want = library.encode_ordinary(t)
        assert ids(raw) == want and ids(b"".join(e.encode(s.parts(t, 7 if len(t) < 100 else 800)))) == want, repr(t)


def test_encoding_equals_the_library(spark, library):
    rows = [(i, t, b"clash", "x", 1) for i, t in enumerate(ODD)] + [(None, "a b", None, "y", 2), (4, "a", None, "y", 2)] + [(1000 + i, t, None, None, None) for i, t in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, key string, row int")
    for leaf in (bytepairs.LEAF_CHARS, 60):
        coded = bytepairs.encode(docs, PATH, P.PATTERN, leaf_chars=leaf)
        want = sorted((str(r[0]), len(x := library.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytepairs.digests(coded, PATH).collect())
        assert got == want
    assert bytepairs.encode(docs.where("false"), PATH, P.PATTERN).count() == 0


def test_long_texts_are_dealt_over_tasks():
    text = "some words, then 123abc! " * 20_000
    parts = bytepairs.splitter(P.PATTERN).parts(text, 65_536)
    assert "".join(parts) == text and len(parts) >= 7 and max(map(len, parts)) < 66_000


def test_memory_of_matches_is_bounded():
    e = bytepairs.Encoder(PATH, P.PATTERN, remembered=50)
    for i in range(40):
        e.encode([" ".join(f"w{i}x{j}" for j in range(30)) + " " + "q" * 500])
    assert len(e.known) <= 120 and len(e.older) <= 120 and max(map(len, [*e.known, *e.older])) <= bytepairs.LONGEST
