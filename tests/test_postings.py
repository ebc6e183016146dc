"""The stored index against full scoring, and what its bounds save."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.fixed import BM25_B, BM25_K1
from fathomline.operators import postings, sparse
from fathomline.plans import retrieval
from fathomline.session import shared_folder
from fathomline.sources import derived as d
from tests.conftest import SF


@pytest.fixture(scope="module")
def index(spark):
    path = shared_folder(spark, "bm25")
    chunks = d.corpus(spark, SF)
    odd = spark.createDataFrame([("odd-1", None, None, None, "alpha beta alpha"), ("odd-2", "AAPL", "2021", None, None), ("odd-3", "AAPL", None, None, "")], "chunk_id string, ticker string, fiscal_year string, section string, raw_text string")
    chunks = chunks.select(*odd.columns).unionByName(odd).cache()
    postings.build(chunks, path, shard=64)
    return chunks, path


def listed(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


def test_search_equals_full_scoring(spark, index):
    chunks, path = index
    plans = retrieval.plans(spark, SF).select("query_id", "query", "ticker", "fiscal_year", "section")
    more = spark.createDataFrame([(9001, "alpha alpha gamma", None, None, None), (9002, "", "AAPL", None, None), (9003, "alpha", "NOBODY", None, None), (9004, "the of and a", None, "2021", None)], "query_id long, query string, ticker string, fiscal_year string, section string")
    plans = plans.unionByName(more)
    for k in (3, 40):
        assert listed(postings.search(spark, path, plans, k)) == listed(sparse.bm25_search(chunks, plans, k))


def test_groups_of_questions_give_the_same(spark, index, monkeypatch):
    chunks, path = index
    plans = retrieval.plans(spark, SF).select("query_id", "query", "ticker", "fiscal_year", "section")
    whole = listed(postings.search(spark, path, plans, 10))
    monkeypatch.setattr(postings, "ASKED", 50)
    assert listed(postings.search(spark, path, plans.where("query_id < 12"), 10)) == [x for x in whole if x[0] < 12]


def test_postings_are_read_once_and_scores_not_shuffled(spark, index):
    hits = postings.search(spark, index[1], retrieval.plans(spark, SF).select("query_id", "query", "ticker", "fiscal_year", "section"), 10)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_tf") and plan.count("FlatMapCoGroupsInArrow") == 1
    physical = hits._jdf.queryExecution().executedPlan().toString()
    assert physical.count("InMemoryFileIndex") == 2  # postings and chunks
    assert "WindowGroupLimit" in physical  # a shard's lists are cut before they travel


def test_statistics_equal_a_recount(spark, index):
    chunks, path = index
    toks = chunks.select("chunk_id", sparse.cell(chunks).alias("cell"), F.explode(sparse.tokens(F.col("raw_text"))).alias("term"))
    want = {(r.cell, r.term): r.df for r in toks.groupBy("cell", "term").agg(F.countDistinct("chunk_id").alias("df")).collect()}
    assert {(r.cell, r.term): r.df for r in spark.read.parquet(f"{path}/vocabulary").collect()} == want
    blocks = spark.read.parquet(f"{path}/postings")
    assert blocks.agg(F.sum("n")).first()[0] == toks.select("chunk_id", "term").distinct().count()
    assert blocks.groupBy("shard", "term", "block").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("negative", [False, True])
def test_bounds_skip_blocks_and_lose_nothing(negative, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    n, vocabulary = 3000, [f"t{i}" for i in range(30)]
    texts = [[vocabulary[int(x)] for x in np.minimum(rng.zipf(1.4, rng.integers(1, 200)) - 1, 29)] for _ in range(n)]
    t = pa.table({"place": pa.array(range(n)), "cell": ["c"] * n, "tokens": pa.array(texts, pa.list_(pa.string()))})
    blocks = postings._blocks((pa.scalar(0),), t)
    chunks = pa.table({"place": pa.array(range(n)), "chunk_id": [f"{i:05d}" for i in range(n)], "len": [len(x) for x in texts], **{p: ["x"] * n for p in postings.PARTS}})
    shard = postings.Shard(blocks, chunks)
    avg = float(np.mean([len(x) for x in texts]))
    asked = [("t20", 2.5), ("t12", 1.0), ("t3", -0.2 if negative else 0.05)]
    scores = {}
    for i, words in enumerate(texts):
        gains = [w * words.count(q) * (BM25_K1 + 1) / (words.count(q) + BM25_K1 * (1 - BM25_B + BM25_B * len(words) / avg)) for q, w in asked if q in words]
        if gains:
            scores[f"{i:05d}"] = math.fsum(gains)
    want = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = shard.top(asked, avg, shard.admitted("*|*|*"), 10)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    if not negative:
        assert shard.scored < 0.5 * sum(q in x for x in texts for q, _ in asked)


def test_empty_corpus(spark):
    path = shared_folder(spark, "bm25")
    empty = spark.createDataFrame([], "chunk_id string, ticker string, fiscal_year string, section string, raw_text string")
    postings.build(empty, path)
    plans = spark.createDataFrame([(1, "alpha", None, None, None)], "query_id long, query string, ticker string, fiscal_year string, section string")
    assert postings.search(spark, path, plans).count() == 0
