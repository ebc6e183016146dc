"""Statistics kept by signed changes against a full recount of the store."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions.text import tokens
from fathomline.operators import postings, sparse
from fathomline.session import shared_folder
from fathomline.sources.snapshots import SnapshotStore
from fathomline.sources.termstats import IndexedChunks, TermStatistics

SCHEMA = "chunk_id string, ticker string, fiscal_year string, section string, raw_text string"


def indexed(spark):
    root = shared_folder(spark, "indexed")
    return IndexedChunks(SnapshotStore(spark, f"{root}/chunks", ["chunk_id"], buckets=4), TermStatistics(spark, f"{root}/statistics"))


def recount(rows):
    listed = rows.select(sparse.cell(rows).alias("cell"), "chunk_id", F.explode(tokens(F.col("raw_text"))).alias("term"))
    terms = {(r.cell, r.term): (r.df, r.cf) for r in listed.groupBy("cell", "term").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("cf")).collect()}
    sized = rows.select(sparse.cell(rows).alias("cell"), F.coalesce(F.size(tokens(F.col("raw_text"))), F.lit(0)).alias("len"))
    return terms, {r.cell: (r.n, r.len) for r in sized.groupBy("cell").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()}


def kept(x):
    terms = {(r.cell, r.term): (r.df, r.cf) for r in x.statistics.terms().collect()}
    return terms, {r.cell: (r.n, r.len) for r in x.statistics.cells().collect()}


def rows_of(rng, ids):
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(["alpha", "beta", "gamma", "1.5", "Delta"]) for _ in range(rng.randrange(7)))
    return [(i, rng.choice(["AAPL", "MSFT", None]), rng.choice(["2021", None]), rng.choice(["risk", "mda"]), text()) for i in ids]


def test_any_sequence_equals_a_recount(spark):
    rng, x = random.Random(5), indexed(spark)
    for batch in range(7):
        if batch % 3 == 2:
            gone = spark.createDataFrame([(str(i),) for i in rng.sample(range(14), 5)] + [(None,)], "chunk_id string")
            assert x.delete(batch, gone, ["chunk_id"])
        else:
            assert x.upsert(batch, spark.createDataFrame(rows_of(rng, [str(i) for i in rng.sample(range(14), 8)]), SCHEMA))
        assert kept(x) == recount(x.store.read())
    before = kept(x)
    assert not x.upsert(4, spark.createDataFrame(rows_of(rng, ["1"]), SCHEMA))  # done before
    assert kept(x) == before
    sizes = [n for _, n in x.statistics.manifest()["folders"]]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    whole = x.store.read()
    want = {r.term: (r.df, r.cf, round(r.idf, 9)) for r in sparse.bm25_index(whole).collect()}
    assert {r.term: (r.df, r.cf, round(r.idf, 9)) for r in x.statistics.vocabulary().collect()} == want
    path = shared_folder(spark, "bm25")
    postings.build(whole, path)
    listed = lambda df: sorted((r.scope, r.n_docs, round(r.avg_len, 9), None if r.floor_idf is None else round(r.floor_idf, 9)) for r in df.collect())
    assert listed(x.statistics.scopes()) == listed(spark.read.parquet(f"{path}/scopes"))


def test_delete_by_other_columns_and_to_nothing(spark):
    x = indexed(spark)
    x.delete(0, spark.createDataFrame([("AAPL",)], "ticker string"), ["ticker"])  # empty store
    x.upsert(1, spark.createDataFrame([("a", "AAPL", "2021", "risk", "one two two"), ("b", "MSFT", "2021", "risk", "two")], SCHEMA))
    x.delete(2, spark.createDataFrame([("AAPL",)], "ticker string"), ["ticker"])
    assert kept(x) == ({("MSFT|2021|risk", "two"): (1, 1)}, {"MSFT|2021|risk": (1, 1)})
    x.delete(3, spark.createDataFrame([("b",)], "chunk_id string"), ["chunk_id"])
    assert kept(x) == ({}, {}) and x.statistics.manifest()["folders"] == []


def test_a_stopped_batch_is_finished_by_its_repeat(spark, monkeypatch):
    x = indexed(spark)
    first = spark.createDataFrame([("a", "AAPL", "2021", "risk", "one two")], SCHEMA)
    x.upsert(0, first)
    second = spark.createDataFrame([("a", "MSFT", None, None, "three")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(x.store, "upsert", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            x.upsert(1, second)
    with pytest.raises(ValueError, match="repeat it first"):
        x.upsert(2, first)
    assert x.upsert(1, second) and not x.upsert(1, second)
    # fields that come empty keep their value, in the store and in the statistics
    assert kept(x) == recount(x.store.read()) == ({("MSFT|2021|risk", "three"): (1, 1)}, {"MSFT|2021|risk": (1, 1)})


def test_repeated_and_null_keys_are_refused(spark):
    x = indexed(spark)
    for ids in (["a", "a"], [None]):
        with pytest.raises(ValueError, match="refused"):
            x.upsert(0, spark.createDataFrame([(i, "AAPL", "2021", "risk", "one") for i in ids], SCHEMA))
    assert kept(x) == ({}, {}) and x.store.read() is None


def test_only_changed_rows_are_counted(spark):
    x = indexed(spark)
    rows = spark.createDataFrame([(str(i), "AAPL", "2021", "risk", f"common word{i}") for i in range(200)], SCHEMA)
    x.upsert(0, rows)
    x.upsert(1, rows.withColumn("raw_text", F.when(F.col("chunk_id") == "7", "other").otherwise(F.col("raw_text"))))
    sizes = [n for _, n in x.statistics.manifest()["folders"]]
    assert sizes == [202, 4]  # common, word7 and other, and the cell
    assert kept(x) == recount(x.store.read())


def test_texts_of_an_emptied_cell_are_not_counted_again(spark, monkeypatch):
    """A change of every chunk of a cell counted all old texts with -1."""
    from fathomline.sources import termstats

    x, seen = indexed(spark), []
    monkeypatch.setattr("fathomline.session.shared_folder", None)  # all files lie below the statistics' own folder
    count = termstats._counted
    monkeypatch.setattr(termstats, "_counted", lambda rows: (seen.append(sorted((r.ticker, r.sign) for r in rows.collect())), count(rows))[1])
    old = spark.createDataFrame([("a", "draft", None, "risk", "one two two"), ("b", "draft", None, "risk", "two"), ("c", "MSFT", None, "risk", "six")], SCHEMA)
    x.upsert(0, old)
    x.upsert(1, spark.createDataFrame([("a", "AAPL", None, "risk", "one two"), ("b", "MSFT", None, None, None), ("d", "AAPL", None, "risk", "two")], SCHEMA))
    assert seen[1] == [("AAPL", 1), ("AAPL", 1), ("MSFT", 1)]
    assert kept(x) == recount(x.store.read())
    x.delete(2, spark.createDataFrame([("a",), ("d",), ("c",)], "chunk_id string"), ["chunk_id"])
    assert seen[2] == [("MSFT", -1)]
    assert kept(x) == recount(x.store.read()) == ({("MSFT||risk", "two"): (1, 1)}, {"MSFT||risk": (1, 1)})
