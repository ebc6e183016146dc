"""Words that hold the beginning of no term are left out before they are cut into pieces."""

import re

import pytest

from fathomline.operators import verify

BY = ["ticker", "fiscal_year"]


@pytest.mark.parametrize("most", [4096, 2])
def test_found_terms_are_those_within_words(spark, monkeypatch, most):
    monkeypatch.setattr(verify, "TERM_STARTS", most, raising=False)
    texts = [("a", "1", "The 1234567 x-1,2 ünit 😀k [a]^b-c"), ("a", "2", "12"), ("b", "1", "nothing here"), ("c", "1", None)]
    asked = [("a", "1", t) for t in ("234567", "34", "1", "9", "ünit", "😀k", "k", "]^", "^b-", "nit ", "THE", "the")]
    asked += [("a", "2", "12"), ("a", "2", "123"), ("b", "1", "ing"), ("b", "2", "ing"), ("c", "1", "x")]
    t = spark.createDataFrame(asked, "ticker string, fiscal_year string, term string")
    c = spark.createDataFrame(texts, "ticker string, fiscal_year string, raw_text string")
    got = {tuple(r) for r in verify.terms_in_text(t, c, BY).collect()}
    words = {(a, b): (x or "").lower().split() for a, b, x in texts}
    assert got == {r for r in asked if any(r[2] in w for w in words.get(r[:2], []))}


def test_pieces_only_of_words_that_can_hold_a_term(spark):
    t = spark.createDataFrame([("a", "1", "12.5%")], "ticker string, fiscal_year string, term string")
    c = spark.createDataFrame([("a", "1", "prose without figures")], "ticker string, fiscal_year string, raw_text string")
    plan = verify.terms_in_text(t, c, BY)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RLIKE|rlike", plan)
