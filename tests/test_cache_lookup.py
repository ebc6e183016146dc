"""The cache serves live, verified entries only: own key first, then near questions."""

from datetime import datetime, timedelta

from fathomline.operators import cache, dense

NOW = datetime(2024, 5, 1)
LATER, BEFORE = NOW + timedelta(days=1), NOW - timedelta(days=1)


def test_lookup(spark):
    kinds = "ticker string, fiscal_year string"
    stored = [
        ("revenue of apple in the year", "AAPL", LATER, True), ("profit of apple in the year", "AAPL", BEFORE, True), ("debt of apple in the year", "AAPL", LATER, False),
        ("cash of nvidia in the year", "NVDA", LATER, None), ("margin of nvidia in the year", "NVDA", NOW, True), ("margin of nvidia in the years", "NVDA", None, True),
    ]
    e = spark.createDataFrame([(q, t, "2024", at, ok) for q, t, at, ok in stored], f"query string, {kinds}, expires_at timestamp_ntz, guardrail_passed boolean")
    e = cache.with_key(e)
    e = e.join(dense.hashed_tf(e, "cache_key", "query"), "cache_key")
    asked = [
        (1, " Revenue of Apple in the year ", "AAPL"), (2, "debt of apple in the year", "AAPL"), (3, "revenue in the year of apple", "AAPL"), (4, "profit of apple in the year", "AAPL"),
        (5, "cash of nvidia in the year", "NVDA"), (6, "margin of nvidia in the year", "NVDA"), (7, "revenue of apple in the year", "TSLA"), (8, "...", "AAPL"),
    ]
    q = spark.createDataFrame([(i, text, t, "2024", NOW) for i, text, t in asked], f"query_id long, query string, {kinds}, asked_at timestamp_ntz")
    q = q.join(dense.hashed_tf(q, "query_id", "query"), "query_id", "left")
    keys = {r.query: r.cache_key for r in e.collect()}
    first = keys["revenue of apple in the year"]
    got = {r.query_id: (r.tier, r.cache_key) for r in cache.lookup(q, e).collect()}
    # 3 and 4: near the only live, verified entry; 2: the own entry is there, but not verified
    assert got == {1: ("exact", first), 2: ("miss", None), 3: ("fast", first), 4: ("second", first), 5: ("miss", None), 6: ("miss", None), 7: ("miss", None), 8: ("miss", None)}


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    t = spark.range(60).select(F.col("id").alias("query_id"), F.concat(F.lit("words of text "), F.repeat(F.lit("a b "), F.col("id").cast("int")), F.col("id").cast("string")).alias("query"), F.lit("n").alias("cache_ns"))
    t = t.join(dense.hashed_tf(t, "query_id", "query"), "query_id").persist()
    e = t.withColumn("cache_key", F.format_string("k%03d", "query_id"))
    q = spark.createDataFrame(t.collect(), t.schema)
    found = lambda: sorted(map(tuple, cache.lookup_semantic(q, e).collect()))
    want = found()
    monkeypatch.setattr(cache, "BLOCK_BYTES", 8000)
    held, n = cache._blocks(e, "cache_key", "query", "embedding")
    size = F.octet_length("query") + 8 * F.size("embedding")
    parts = -(-e.agg(F.sum(size)).first()[0] // 8000)
    assert n.first()["n"] == parts > 3 and held.select("own").distinct().count() > 3
    assert found() == want
