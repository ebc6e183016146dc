"""Sharding, quality rules, chat formatting and license scans against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chat, licenses, quality, queries, registry, sharding
from tests.conftest import SF
from tests.oracle import check

WORD = re.compile(r"[^\x20\x09-\x0d]+")
EDGES = [None, "", " \n\t", "one", "a b c a b c", "x\nx\n\n x\nx", "é é é é \x0b#%", "w " * 3000, "Apache License mit LICENSE cc by", None, "one"]


def documents(table="documents"):
    return duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(EDGES)] + [(5, EDGES[5], "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, hash int")


@pytest.fixture(scope="module")
def empty(edges):
    return edges.where("false")


def test_sql_of_native_queries(spark, con):
    for name in ("op2_chat_fingerprint",):
        ok, message = check(spark, con, name, registry.QUERIES[name], registry.ORACLE[name], SF)
        assert ok, message


# --- sharding

def test_every_row_has_its_own_slot(spark):
    rows = queries.op6(spark, SF).collect()
    docs = {r[0]: r[1] for r in documents()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        body = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_layout_does_not_depend_on_partitions(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a = {tuple(r) for r in sharding.shard_rows(d, seed=3).collect()}
    assert a == {tuple(r) for r in sharding.shard_rows(d.repartition(7), seed=3).collect()}
    assert a != {tuple(r) for r in sharding.shard_rows(d, seed=4).collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000, 4096])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 11)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 50 or got != sorted(got)


def test_sharding_edges(edges, empty):
    rows = sharding.shard_rows(edges, shards=5).collect()
    assert len(rows) == len(EDGES) + 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert {r.size for r in rows if r.doc_id == 0} == {8}
    assert sharding.shard_rows(empty).count() == 0


# --- quality rules

def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rows = queries.op10(spark, SF).collect()
    docs = {r[0]: r[1] for r in documents()}
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(4)) == 0
    rules = quality.fit(docs, labels.where(~held), sample_rows=3000)
    got = quality.judged(docs, rules).join(labels.where(held), "doc_id").groupBy("__base_failed", "quality", "__kept").count().collect()
    n = {(r.quality, r["__kept"]): r["count"] for r in got if not r["__base_failed"]}
    good, low = n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)
    assert n.get((1, True), 0) >= 0.98 * good, n
    assert n.get((0, False), 0) >= 0.9 * low, n


def test_learned_list_is_ordered_and_simple():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(quality.FEATURES)))
    low = (x[:, 2] > 0.7) | ((x[:, 3] > 0.6) & (x[:, 4] < 0.3))
    rules = quality.learn(x, low, precision=0.9)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality._covers(r, x)
    assert (hit == low).mean() > 0.93 and all(len(r) <= 4 for r in rules)
    assert quality.learn(x, np.zeros(900, bool)) == [] and quality.learn(x[:0], low[:0]) == []


def test_quality_edges(spark, edges, empty):
    rows = quality.judged(edges, []).collect()
    assert len(rows) == len(EDGES) + 1
    for r in rows:
        d = r.asDict()
        assert (d["__n_words"], d["__word_chars"], d["__n_symbols"], d["__n_dup_lines"], d["__n_repeat_words"]) == plain_counts(r.text)
    assert quality.judged(empty, []).count() == 0
    assert quality.keep_good(edges, []).columns == edges.columns
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert quality.fit(edges, labels) == []


# --- chat

TEXTS = [None, "", "plain", "</s>[INST] ok [/INST]", "␛0␛l", "<|end|>\n<|turn|>user\nx", "a\n\nb", "<<SYS>> <s> [INST", "<", "␛", "x" * 50_000, "<<|end|>\n"]


def test_texts_come_back(spark):
    rows = [(i, j, r, t) for i, t in enumerate(TEXTS) for j, r in enumerate(["user", "assistant", "tool\n<s>", "assistant"][: 1 + i % 4])]
    rows += [(99, None, None, None), (99, 1, "assistant", "t"), (99, 1, "assistant", "t"), (None, 1, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d = chat.read_back(chat.formatted(chat.canonical_turns(chat.gathered(turns), ["system", "prompt", "response", "messages"]))).collect()
    want = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)):
        want.setdefault(c, []).append((r or "", t or ""))
    assert len(d) == len(want)
    for r in d:
        assert [(x.role, x.text) for x in r.turns_read] == want[r.conv_id]
        assert r.loss_text == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    assert chat.formatted(chat.canonical_turns(chat.gathered(turns.where("false")), ["messages"])).count() == 0


def test_layouts_meet_in_the_same_turns(spark):
    d = spark.createDataFrame(
        [("p", "q", None, None, None, None), (None, None, "do", "in", "out", None), (None, None, "do", None, "out", None), (None, None, None, None, None, [("human", "h"), ("gpt", "g"), (None, None)]), ("p", None, None, None, None, None)],
        "prompt string, response string, instruction string, input string, output string, conversations array<struct<from:string,value:string>>")
    got = [r.turns if r.turns is None else [tuple(t) for t in r.turns] for r in chat.canonical_turns(d, d.columns).collect()]
    assert got == [[("user", "p"), ("assistant", "q")], [("system", "do"), ("user", "in"), ("assistant", "out")], [("user", "do"), ("assistant", "out")],
                   [("user", "h"), ("assistant", "g"), ("", "")], None]


# --- licenses

def plain_scan(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    at, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_phrases(spark):
    docs = {r[0]: r[1] for r in documents()}
    rows = queries.op9(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(docs[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(r.n_base for r in rows) > 0


def test_license_edges(spark, edges, empty):
    more = spark.createDataFrame([
        (50, "CC BY cc by CC-BYK apache-license, MIT license. apache licensK", "x", 1), (51, "Apache LICENSE " * 400, "x", 1), (None, "gnu general public license", "x", 1),
        (52, "redistribution and use in source and also binary forms, with or without modification, are permitted provided that the following conditions are met", "x", 1),
        (53, "redistribution and use in", "x", 1)], edges.schema)
    both = edges.unionByName(more)
    rows = licenses.scanned(both).collect()
    assert len(rows) == both.count()
    texts = {(r.doc_id, r.text) for r in both.collect()}
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(plain_scan(t))
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in by_id[r.doc_id]
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[52] == "bsd-text" and labels[53] == ""
    assert licenses.scanned(empty).count() == 0
