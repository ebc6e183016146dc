"""Encoding, packing and substring dedup against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import bpe, packing, substrings
from fathomline.llm.words import Words, run_min
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "don't I'LL ''s '''ve", "x<|endoftext|>y <|endoftext|", "é ́a é.….", "Å b\tc\r\nd\x1ce", "你好 123 4.5", "ÀÉß ŒÖ&&& %%%*** A&B", "İstanbul ſ K", "\x00 \x7f",
       "ab" * 9000, "abc'" * 5000, "é́" * 5000, "word, " * 9000, ("q" * 5000 + " ") * 5, "<|endoftext|>" * 2000]


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, b"clash", 1, "x") for i, t in enumerate(ODD)] + [(None, "a b", None, 2, "y"), (4, "a", None, 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids binary, length long, key string")


def reference(text):
    return bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


# --- encoding

def test_tree_equals_one_encoding():
    tok, rng = bpe.tokenizer(PATH), random.Random(4)
    kinds = ["abcdeé", "ab ", "'s.t", "aé́̂", "<|endoftext|>ab", "xyzæ你", "a1b2 \n", "thereisation"]
    for n in range(160):
        text = "".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randint(1, 700)))
        if n % len(kinds) == 4:
            text = "".join(rng.choice(["<|endoftext|>", "<|", "a", " "]) for _ in range(120))
        assert bpe.tree(tok, text, leaf=40)[0].tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoding_equals_the_library(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in documents()], "doc_id long, text string"))
    for leaf in (bpe.LEAF_CHARS, 50):
        got = bpe.encode(docs, PATH, leaf_chars=leaf)
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(reference(r.text))
        back = defaultdict(list)
        for r in got.collect():
            back[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
        assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in back.items()}
    tok = bpe.tokenizer(PATH)
    for r in bpe.digests(got, PATH).join(docs, "doc_id").collect():
        ids = reference(r.text)
        if r.doc_id != 4:
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
            assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(odd.where("false"), PATH).count() == 0


def test_memory_of_words_is_bounded():
    e = bpe.Encoder(PATH, remembered=50)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [reference(t) for t in texts]
    for t in texts:
        e.encode([t])
    assert len(e.words) <= 50 >= len(e.words.older) and len(e.letters) <= 100 >= len(e.letters.older)


def test_letters_and_marks_of_simple_words():
    tok, rng = bpe.tokenizer(PATH), random.Random(9)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + "".join(rng.choices(marks, k=rng.randint(0, 3))) for _ in range(4000)]
    assert all(bpe.SIMPLE.fullmatch(w) for w in words)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(PATH).encode(words)] == [reference(w) for w in words]


# --- packing

def check_packing(rows, want, capacity):
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def plain_best_fit(lengths, capacity):
    rests = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rests) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rests[i])
            rests[i] -= n
        else:
            rests.append(capacity - n)
    return len(rests)


@pytest.mark.parametrize("seed", range(12))
def test_counts_pack_as_single_pieces_do(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else min(capacity, 3) for _ in range(rng.choice([0, 1, 40, 400]))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    table, opened = packing.best_fit(counts, capacity)
    assert opened == plain_best_fit(lengths, capacity)
    used = defaultdict(list)
    for n in counts:
        t = table[table[:, 0] == n]
        t = t[np.argsort(t[:, 1])]
        for rank in range(counts[n]):
            _, begin, each, first, place = t[np.searchsorted(t[:, 1], rank, "right") - 1]
            used[first + (rank - begin) // each].append((place + (rank - begin) % each * n, n))
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) == opened


def test_packing_of_documents(spark, odd):
    docs = odd.select("doc_id", "text").where("doc_id IS NOT NULL").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in documents()], "doc_id long, text string"))
    cut = packing.pieces(bpe.encode(docs, PATH), 2048)
    want, total = [], []
    for r in docs.collect():
        ids = np.array(reference(r.text) + [0], "<u4")
        for p in range(0, len(ids), 2048):
            part = ids[p:p + 2048]
            want.append((r.doc_id, p // 2048, p, len(part), zlib.crc32(part.tobytes())))
            total.append(len(part))
    n = check_packing(packing.packed(cut, 2048).collect(), want, 2048)
    assert n == plain_best_fit(total, 2048)
    assert packing.packed(packing.pieces(bpe.encode(docs.where("false"), PATH), 2048), 2048).count() == 0
    assert packing.packed(packing.pieces(bpe.encode(odd, PATH), 64), 64).count() > len(ODD)


# --- substrings

def plain_removed(rows, window):
    """(id, text) pairs to (n_words, kept words)."""
    owner = {}
    split = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            owner[g] = min(owner.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if owner[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


LAST = substrings.LAST


def got_removed(df):
    rows = df.collect()
    for r in rows:
        assert sum(s["last"] - s["first"] for s in r.removed) == r.n_removed
    return sorted((LAST if r.c_doc_id is None else r.c_doc_id, r.n_words, r.n_removed, r.kept) for r in rows)


def test_words_are_found_in_sliced_columns():
    texts = ["zz", None, "a b\tc", "", "  d\x0be ", "é f", None, "b c"]
    w = Words(pa.array(texts).slice(1))
    assert w.count.tolist() == [0, 3, 0, 2, 1, 0, 2] and w.hash[1] == w.hash[6] and w.hash[2] == w.hash[7]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.first, w.last)] == ["a", "b", "c", "d", "e", "é f", "b", "c"]
    assert len(Words(pa.array([None, ""], pa.string())).hash) == 0 and len(Words(pa.array([], pa.string())).hash) == 0
    v = np.array([5, 3, 4, 1, 7, 2], np.uint64)
    assert run_min(v, 4).tolist() == [1, 1, 1]


@pytest.mark.parametrize("seed", range(6))
def test_index_counts_patterns(seed):
    rng = np.random.default_rng(seed)
    symbols = np.concatenate([np.append(rng.integers(1, 4, rng.integers(5, 40)), 0) for _ in range(8)])
    index = substrings.Index(symbols, 5)
    text = symbols.tolist()
    for at in range(len(text) - 5):
        p = text[at:at + 5]
        low, high = np.zeros(1, np.int64), np.array([index.size])
        for c in reversed(p):
            low, high = index.extend(np.array([c]), low, high)
        if 0 not in p:
            assert int(high[0] - low[0]) == sum(text[i:i + 5] == p for i in range(len(text)))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_go_from_later_documents(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if rng.random() < 0.5 else f"longer{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 14, 30, 60]))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages)[rng.randint(0, 3):] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice([i, i, i, i - 1, None]) if i else 0, " ".join(w) if rng.random() < 0.95 else None))
    rows += rows[:6] + [(500, "a " * 700), (501, "b " + "a " * 40), (7, ""), (8, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hash string, id int").repartition(5)
    assert got_removed(substrings.without_repeats(df)) == plain_removed(rows, 13)


def test_repeats_in_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = got_removed(substrings.without_repeats(df))
    assert got == plain_removed(documents(), 13)
    assert sum(r[2] for r in got) > 0
    assert substrings.without_repeats(df.where("false")).count() == 0
