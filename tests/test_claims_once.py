"""Answers are read and searched for claims once, and a claim meets one row of evidence."""

import random

from pyspark.sql import functions as F

from fathomline.operators import verify

BY = ["ticker", "fiscal_year"]


def test_close_figures_are_found_as_by_all_pairs(spark):
    rng = random.Random(9)
    some = lambda: rng.choice([0.0, 0.06, 0.13, 1.0, 3.0, 23.9, 24.0, 24.1, 100.0, 1e6]) * rng.choice([1, 1.004, 0.9951, 1.006])
    claims = [(i, rng.choice(["a", "b", "c", None]), "1", None if i % 17 == 0 else some()) for i in range(300)]
    texts = [(t, "1", " ".join(f"{some():.4f}" for _ in range(6))) for t in ("a", "b", None) for _ in range(2)]
    evidence = verify.evidence_numbers(spark.createDataFrame(texts, "ticker string, fiscal_year string, raw_text string"), BY)
    near = verify.near_figures(evidence, BY)
    assert near.groupBy(*BY, "bucket").count().where("count > 1").isEmpty() and near.agg(F.max(F.size("figures"))).first()[0] <= 10
    out = verify.claims_vs_evidence(spark.createDataFrame(claims, "i long, ticker string, fiscal_year string, value double"), evidence, BY)
    figures = {t: [float(x) for k, _, s in texts if k == t for x in s.split()] for t in ("a", "b")}
    close = lambda v, x: abs(v - x) <= max(0.005 * max(abs(v), abs(x)), 0.12)
    want = {i: v is not None and any(close(v, x) for x in figures.get(t, [])) for i, t, _, v in claims}
    assert {r.i: r.matched for r in out.collect()} == want and len(set(want.values())) == 2


def test_answers_are_read_once(spark):
    answers = spark.createDataFrame([(1, "AAPL", "2021", "AAPL had a gross margin of 50%.", "What is the gross margin?"), (2, "ALL", "2021", "Revenue was $7.", "How much?"), (3, "MSFT", "2021", "No data available", "q")],
                                    "request_id long, ticker string, fiscal_year string, answer string, query string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    store = spark.createDataFrame([("x", "AAPL", "2021", "Total net sales: 200 gross profit: 100"), ("y", "MSFT", "2021", "7")], "chunk_id string, ticker string, fiscal_year string, raw_text string")
    out = verify.grounding_status(answers.mapInArrow(seen, answers.schema), store, store, BY)
    got = {r.request_id: (r.status, r.layer, r.claims, r.supported) for r in out.collect()}
    assert got == {1: ("PASS", "", 2, 2), 2: ("PASS", "", 2, 2), 3: ("FAIL", "Generation", 0, 0)} and read.value == 3
