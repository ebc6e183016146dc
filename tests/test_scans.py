"""Searches that score chunks where they are: equal to joins, and without a shuffle of text or of pairs."""

import re

from pyspark.sql import functions as F

from fathomline.operators import dense, hybrid, sparse
from fathomline.plans import retrieval
from fathomline.sources import derived as d
from tests.conftest import SF


def rows(hits):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in hits.collect())


def test_scan_equals_joins(spark):
    c = d.corpus(spark, SF).persist()
    odd = spark.createDataFrame([("a", None, "2021", "s", "x y x"), ("b", "AAPL", "2021", None, None), ("c", "*", "*", "*", "alpha 1.5"), ("d", "AAPL", "2021", "s", "")],
                                "chunk_id string, ticker string, fiscal_year string, section string, raw_text string")
    c = c.select(*odd.columns).unionByName(odd)
    q = retrieval.plans(spark, SF)
    several = q.withColumn("tickers", F.array(F.lit("aapl "), F.lit("NVDA"), F.lit("NVDA")))
    for p in (q, several, q.limit(0), q.withColumn("query", F.lit("?"))):
        for positive in (False, True):
            assert rows(sparse.bm25_search(c, p, 7, positive)) == rows(sparse.bm25_search(c, p, 7, positive, limit=-1))


def test_small_slices_change_nothing(spark, monkeypatch):
    c, q = d.corpus(spark, SF).persist(), retrieval.plans(spark, SF)
    want = rows(sparse.bm25_search(c, q, 5))
    monkeypatch.setattr(sparse, "SLICE_CELLS", 50)
    assert rows(sparse.bm25_search(c, q, 5)) == want


def test_no_shuffle_by_pair_or_of_text(spark):
    c, q = d.corpus(spark, SF), retrieval.embedded_plans(spark, SF)
    plan = sparse.bm25_search(c, q)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert any("query_id" in x for x in dealt) and not any("chunk_id" in x for x in dealt)
    plan = hybrid.hybrid_search(c, hybrid.corpus_vectors(c), q)._jdf.queryExecution().executedPlan().toString()
    last = plan[:plan.index("Join")]
    assert "Broadcast" in last[last.rindex("\n"):]


def test_vectors_of_repeated_and_empty_texts(spark):
    t = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a a b"), (3, None), (4, "?")], "k int, t string")
    got = {r.k: r.embedding for r in dense.hashed_tf(t, "k", "t").collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and sorted(got[1])[-1] == 2 / 5 ** 0.5
    plan = dense.hashed_tf(t, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
