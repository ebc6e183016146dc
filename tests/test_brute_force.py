"""Operators without SQL, and scale paths, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import fixed
from fathomline.functions import markup as m
from fathomline.operators import context, dense, ingest, percentiles, sparse, windows
from tests.conftest import SF


# --- cleaning ----------------------------------------------------------------
def clean_slow(text):
    """Protect figures and pipe tables by tokens, clean, put them back."""
    if not text.strip():
        return ""
    kept = []

    def hide(s):
        kept.append(s)
        return f"{len(kept) - 1}"

    text = re.sub(m.NOTATION, lambda x: hide(x.group(0)), text)
    out, run = [], []
    for line in text.split("\n") + [None]:
        s = (line or "").strip()
        if line is not None and s.startswith("|") and s.endswith("|") and len(s) > 2:
            run.append(line)
            continue
        if run:
            out.append(hide("\n".join(run)))
            run = []
        if line is not None:
            out.append(line)
    t = "\n".join(out)
    t = re.sub(r'style\s*=\s*"[^"]*"', "", t, flags=re.I)
    t = re.sub(r"<[^>]+>", " ", t)
    for old, new in fixed.CLEAN_ENTITIES:
        t = t.replace(old, new)
    t = re.sub(fixed.BOILERPLATE_PATTERN, "", t, flags=re.I)
    t = re.sub(r"[^\S\n|]+", " ", t)
    t = re.sub(r"\n{3,}", "\n\n", t).strip()
    while re.search("\\d+", t):
        t = re.sub("(\\d+)", lambda x: kept[int(x.group(1))], t)
    return t


def test_cleaning_whole_corpus(spark):
    from fathomline.plans.ingestion import dirty_text

    rows = ingest.clean_financial_text(dirty_text(spark, SF), "body").select("body", "clean_text").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.clean_text == clean_slow(r.body)


@pytest.mark.parametrize("text", ["", "  \n ", "Loss of $(1,234) and $78.1B, 157.8% on $94,949M", "<b>a</b>   b\t\tc", "x\n| a |  b |\n| 1 | (2) |\ny  z",
                                  "Filing Date: 2024-01-01\nkept", "a <td width=5%>b", "$ 5\n| a | b |"])
def test_cleaning_cases(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert ingest.clean_financial_text(df, "t").first().clean_text == clean_slow(text)


# --- chunking ----------------------------------------------------------------
def tok(s):
    return max(1, len(s) // 4)


def chunks_slow(text, hi, lo, overlap):
    text = text.strip()
    if not text:
        return []
    if tok(text) <= hi:
        return [text]
    segs = []
    for p in (x.strip() for x in re.split(r"\n{2,}", text)):
        if not p:
            continue
        for s in ([p] if tok(p) <= hi else [x.strip() for x in re.split(r"(?<=[.!?])\s+", p)]):
            if not s:
                continue
            for w in ([s] if tok(s) <= hi else s.split()):
                segs += [w] if tok(w) <= hi else [w[i:i + 4 * hi] for i in range(0, len(w), 4 * hi)]
    cuts, start, size = [], 0, 0
    for i, s in enumerate(segs):
        if size + tok(s) > hi and i > start:
            cuts.append((start, i))
            room, back, got = min(overlap, hi - tok(s)), i, 0
            while back > start and got + tok(segs[back - 1]) <= room:
                back -= 1
                got += tok(segs[back])
            start, size = back, got
        size += tok(s)
    if cuts and size < lo and sum(map(tok, segs[cuts[-1][0]:])) <= hi:
        cuts[-1] = (cuts[-1][0], len(segs))
    else:
        cuts.append((start, len(segs)))
    return [" ".join(segs[a:b]) for a, b in cuts]


@pytest.mark.parametrize("hi,lo", [(1024, 768), (60, 45), (10, 5)])
def test_chunking_equals_plain_loop(spark, hi, lo):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect() if hi < 100 else spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = [r.text for r in docs] + ["word " * 50, "x" * 500, "A b. C d! E f? " * 40 + "\n\n" + "tail", " ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    got = ingest.chunk_text_bounded(df, "t", max_tokens=hi, min_tokens=lo).select("t", "chunks").collect()
    for r in got:
        assert r.chunks == chunks_slow(r.t, hi, lo, int(hi * 0.2)), r.t[:80]
        # every word of the text is in some chunk: nothing is lost
        if hi >= 60:
            assert set(r.t.split()) <= set(" ".join(r.chunks).split()) or "x" * 400 in r.t


def test_chunk_corpus_indexes(spark):
    text = "Intro\nItem 1. Business  \nfirst\n| a | b |\n(1) note\nItem 7. Results  \n%%TABLE_0%% second\n| c | d |"
    df = spark.createDataFrame([(1, "AAPL", "2024", "f.html", text, ["| P |\n|:---|\n| 1 |"])], "id int, ticker string, fiscal_year string, source_file string, text_content string, tables array<string>")
    rows = sorted(ingest.chunk_corpus(df).collect(), key=lambda r: (r.chunk_type, r.chunk_index))
    assert [(r.chunk_type, r.chunk_index, r.section) for r in rows] == [
        ("table", 0, "Item 7. Results"), ("table", 1, "Item 1. Business"), ("table", 2, "Item 7. Results"),
        ("text", 0, "General"), ("text", 1, "Item 1. Business"), ("text", 2, "Item 7. Results")]
    assert rows[1].raw_text == "| a | b |\n(1) note" and rows[5].raw_text.endswith("%%TABLE_0%% second")
    assert all(re.fullmatch(r"AAPL_(tbl|txt)_[0-9a-f]{12}_\d{4}", r.chunk_id) for r in rows)


def test_chunk_corpus_keeps_every_word(spark):
    from fathomline.plans.ingestion import mixed_text

    docs = mixed_text(spark, SF).select("doc_id", F.lit("AAPL").alias("ticker"), F.lit("2024").alias("fiscal_year"), F.col("doc_id").cast("string").alias("source_file"), F.col("body").alias("text_content"))
    out = ingest.chunk_corpus(docs, tables=None).groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("raw_text")).alias("all"))
    rows = out.join(docs, "doc_id").select("all", "text_content").collect()
    assert len(rows) == 200
    for r in rows:
        assert set(r.text_content.split()) <= set(r["all"].split())


def test_stream_ingest_fills_both_stores_and_is_repeatable(spark):
    from fathomline.plans.ingestion import raw_filings
    from fathomline.streaming.chunks import filing_chunks
    from fathomline.plans.streams import stream_chunk_ingest

    got = stream_chunk_ingest(spark, SF).collect()
    files = raw_filings(spark, SF).select(F.concat(F.col("page_id").cast("string"), F.lit("/"), "path").alias("path"), "content")
    want = {(r.path, r.chunk_id) for r in filing_chunks(files).select("path", "chunk_id").collect()}
    assert {(r.path, r.chunk_id) for r in got} == want and len(got) == len(want)
    assert all(r.dims == dense.HASH_DIM for r in got)


# --- vectors -----------------------------------------------------------------
def test_knn_grid_equals_broadcast_equals_numpy(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.format_string("%08d", "vec_id").alias("chunk_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("ticker"), "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("ticker")).alias("ticker"))
    key = lambda df: {(r.query_id, r["rank"], r.chunk_id) for r in df.collect()}
    small = key(dense.knn_hits(e, q, 7))
    assert small == key(dense.knn_hits(e, q, 7, broadcast_limit=10))
    assert small == key(dense.knn_hits(e.repartition(13), q.repartition(3), 7))
    rows = e.orderBy("vec_id").collect()
    mat = np.array([r.embedding for r in rows], dtype="float64")
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    for i in (0, 1, 77):
        s = (mat @ mat[i]).round(9)
        ok = [j for j in range(len(rows)) if i % 2 or rows[j].ticker == rows[i].ticker]
        best = sorted(ok, key=lambda j: (-s[j], rows[j].chunk_id))[:7]
        assert [rows[j].chunk_id for j in best] == [c for _, _, c in sorted(x for x in small if x[0] == rows[i].vec_id)]


def test_grid_with_several_cells(spark, monkeypatch):
    monkeypatch.setattr(dense, "CELL_QUESTIONS", 100)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.format_string("%08d", "vec_id").alias("chunk_id"), "vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: {(r.query_id, r["rank"], r.chunk_id) for r in df.collect()}
    for c in fixed_parts():
        e, q = e.withColumn(c, F.lit(None).cast("string")), q.withColumn(c, F.lit(None).cast("string"))
    grid = sparse.rank_top(dense._grid_hits(e.drop("vec_id"), q, 5, cell_vectors=120), 5, ["query_id"])
    assert key(grid) == key(dense.knn_hits(e, q, 5))


def fixed_parts():
    from fathomline.operators.scopes import PARTS

    return PARTS


def test_bm25_against_plain_formula(spark):
    docs = ["net sales rose", "net income fell fell", "the board met", "sales of 724.5 million", ""]
    c = spark.createDataFrame([(f"c{i}", t, "A", "2024", "s") for i, t in enumerate(docs)], "chunk_id string, raw_text string, ticker string, fiscal_year string, section string")
    q = spark.createDataFrame([(1, "net sales net 724.5"), (2, "absent")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in sparse.bm25_scores(c, q).collect()}
    toks = [re.findall(fixed.TOKEN_PATTERN, d.lower()) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    idf = {t: np.log(n - f + 0.5) - np.log(f + 0.5) for t, f in df.items()}
    eps = 0.25 * np.mean(list(idf.values()))
    idf = {t: eps if v < 0 else v for t, v in idf.items()}
    for i, d in enumerate(toks):
        terms = ["net", "sales", "net", "724.5"]
        want = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in terms)
        if set(terms) & set(d):
            assert got.pop((1, f"c{i}")) == pytest.approx(want)
    assert not got


# --- windows, percentiles, budgets -------------------------------------------
def test_percentiles(spark):
    rnd = random.Random(3)
    data = [("a", rnd.choice([1.0, 2.0, 3.5, rnd.uniform(0, 1e6)])) for _ in range(500)] + [("b", 5.0)] + [("c", float(v)) for v in (1, 1, 1, 9)] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in percentiles.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, ["k"]).collect()}
    near = {r.k: r.p95 for r in percentiles.exact_percentiles(df, "v", {"p95": 0.95}, ["k"], nearest=True).collect()}
    for k in "abc":
        v = sorted(x for g, x in data if g == k and x is not None)
        assert got[k].p50 == pytest.approx(np.percentile(v, 50)) and got[k].p95 == pytest.approx(np.percentile(v, 95))
        assert near[k] == v[min(int(len(v) * 0.95), len(v) - 1)]


def test_carry_forward_blocks(spark):
    rnd = random.Random(5)
    rows = [(g, t, rnd.choice([None, None, t])) for g in (1, 2) for t in range(3, 60)]
    df = spark.createDataFrame(rows, "g int, t long, v long")
    for block in (4, 1000):
        got = {(r.g, r.t): r.last for r in windows.carry_forward(df, "g", "t", {"last": F.col("v")}, block).collect()}
        for g in (1, 2):
            last = None
            for gg, t, v in rows:
                if gg == g:
                    assert got[(g, t)] == last
                    last = v if v is not None else last


def test_budget_is_the_sequential_loop(spark):
    rnd = random.Random(11)
    docs = [(r, i, f"c{r}-{i}", rnd.choice(["A", "B"]) if r % 2 else "A", f"sec {rnd.randint(0, 9)}", "w" * rnd.choice([0, 10, 900, 4000])) for r in range(12) for i in range(20)]
    df = spark.createDataFrame(docs, "request_id long, rank int, chunk_id string, ticker string, section string, raw_text string")
    got = {(r.request_id, r.chunk_id): r.kept for r in context.budget_context(df, total=5000).collect()}
    for req in range(12):
        mine = [d for d in docs if d[0] == req]
        many, left, seen, per = len({d[3] for d in mine}) > 1, 5000, set(), {}
        for _, _, cid, tk, sec, text in mine:
            if (many and per.get(tk, 0) >= 2) or (tk, sec) in seen:
                continue
            seen.add((tk, sec))
            take = text[:1500][:left]
            if take:
                left -= len(take)
                per[tk] = per.get(tk, 0) + 1
                assert got.pop((req, cid)) == len(take)
    assert not got
