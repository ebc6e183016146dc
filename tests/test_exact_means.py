"""Rounded means: halves go up whatever the order in which rows are added."""

import itertools

import pytest

from fathomline.operators import analytics

SCHEMA = "user long, total_latency_ms double, ttft_ms double, guardrail_status string, cache_hit boolean"
#: their mean is 32.85; added as doubles in this order it is 32.849999999999994
HALF = [19.69, 50.98, 53.72, 18.87, 20.73, 33.11]


def rows(values, user):
    return [(user, v, -v, "passed", True) for v in values]


def both(spark, data):
    e = spark.createDataFrame(data, SCHEMA).coalesce(1)
    once = analytics.perf_summary(e, None, ["user"])
    parts = analytics.perf_from_parts(e.groupBy("user").agg(*analytics.perf_parts()), ["user"])
    return [{r.user: (r.avg_latency_ms, r.avg_ttft_ms) for r in df.collect()} for df in (once, parts)]


def test_halves_go_up_in_every_order(spark):
    data = [r for i, p in enumerate(itertools.islice(itertools.permutations(HALF), 0, 720, 7)) for r in rows(p, i)]
    for got in both(spark, data):
        assert set(got.values()) == {(32.9, -32.9)}


def test_values_that_no_exact_sum_holds(spark):
    data = [(1, 5.0, float("inf"), "", False), (2, None, 1e20, "", False), (2, None, 2e20, "", False), (3, None, None, "", False)]
    for got in both(spark, data):
        assert got == {1: (5.0, float("inf")), 2: (0.0, 1.5e20), 3: (0.0, 0.0)}


@pytest.mark.parametrize("n", [3, 7])
def test_other_means_are_as_before(spark, n):
    data = rows([0.05 * i + 0.01 for i in range(n)], 1)
    for got in both(spark, data):
        assert got[1][0] == round(sum(r[1] for r in data) / n, 1)
