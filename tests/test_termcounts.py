"""Terms counted in Arrow blocks against the pattern and a plain count."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.fixed import TOKEN_PATTERN
from fathomline.functions import termcounts
from fathomline.functions.text import tokens
from fathomline.sources.termstats import signed_counts

ODD = [None, "", " ", "1.2.3.4", "a.5b.6", "1.2a.3", "x..1 .5 5.", "v1.02.", "KELVIN İx été café.5", "1." + "5" * 100 + ".7z", "1." + "2" * 32 + ".4"]


def test_tokens_are_the_matches_of_the_pattern():
    rng = random.Random(3)
    for _ in range(2000):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("a1.9 .é") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(6))]
        arrow = pa.array([None, "x "] + [None if t is None else t + " " for t in texts], pa.string()).slice(2)
        got, row = termcounts.token_strings(arrow)
        assert list(zip(row.tolist(), got.to_pylist())) == [(i, m) for i, t in enumerate(texts) for m in re.findall(TOKEN_PATTERN, t or "")]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_blocks_add_up_to_a_plain_count(block, monkeypatch):
    monkeypatch.setattr(termcounts, "BLOCK_BYTES", block)
    monkeypatch.setattr(termcounts, "PASSED_ROWS", 3)
    rng, df, cf = random.Random(8), Counter(), Counter()
    rows = [(rng.choice("xy"), rng.choice([-1, 1]), rng.choice([None, "a b a ", "", "1.5 b ", "c "])) for _ in range(60)]
    for g, sign, t in rows:
        found = re.findall(TOKEN_PATTERN, t or "")
        for m in found:
            cf[g, m] += sign
        for m in [*set(found), None]:
            df[g, m] += sign
        cf[g, None] += sign * len(found)
    part, signs, texts = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(part), pa.array(signs, pa.int32()), pa.array(texts, pa.string())], names=["g", "sign", "t"])
    got_df, got_cf = Counter(), Counter()
    for b in termcounts.count_terms([batch.slice(0, 25), batch.slice(0, 0), batch.slice(25)]):
        for r in b.to_pylist():
            got_df[r["g"], r["term"]] += r["df"]
            got_cf[r["g"], r["term"]] += r["cf"]
    assert all(got_df[k] == df[k] and got_cf[k] == cf[k] for k in {*df, *cf, *got_df})


def test_odd_texts_as_the_column_expression_finds_them(spark):
    rows = spark.createDataFrame([("A", "1", None, t, 1) for t in ODD], "ticker string, fiscal_year string, section string, raw_text string, sign int")
    found = Counter(r.t for r in rows.select(F.explode(tokens(F.col("raw_text"))).alias("t")).collect())
    got = {r.term: r.cf for r in signed_counts(rows).collect()}
    assert got.pop(None) == sum(found.values()) and got == found


def test_no_row_for_each_token(spark):
    """Counting made one or two rows of every token and aggregated those."""
    text = " ".join(f"w{i % 50}" for i in range(5000))
    rows = spark.createDataFrame([("A", "1", "s", text, 1)] * 8, "ticker string, fiscal_year string, section string, raw_text string, sign int")
    counted = signed_counts(rows)
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.term, r.df, r.cf) for r in counted.collect()} == {(f"w{i}", 8, 800) for i in range(50)} | {(None, 8, 40000)}
