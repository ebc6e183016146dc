"""Retrieval for several companies, each question with its own."""

from pyspark.sql import functions as F

from fathomline.operators import hybrid

COMPANIES = ["AAPL", "MSFT", "TSLA", "ORCL", "IBM"]
WORDS = ["revenue", "margin", "cloud", "risk", "debt", "growth", "cash"]


def chunks(spark):
    rows = [(f"{t}-{k:02d}", t, "2024", "Item 7", False, f"{t.lower()} {WORDS[k % 7]} {WORDS[(3 * k + i) % 7]} note {k}") for i, t in enumerate(COMPANIES) for k in range(12)]
    return spark.createDataFrame(rows, "chunk_id string, ticker string, fiscal_year string, section string, contains_table boolean, raw_text string")


ASKED = [(1, "cloud revenue growth", ["TSLA", " orcl ", "TSLA", None]), (2, "cash and debt", ["IBM"]), (3, "risk of margin", ["AAPL", "MSFT", "TSLA", "ORCL", "IBM"]), (4, "margin", []), (5, "debt", None)]


def plans(spark):
    q = spark.createDataFrame(ASKED, "query_id long, query string, tickers array<string>")
    q = q.withColumns({"ticker": F.when(F.col("query_id") == 5, "MSFT"), "fiscal_year": F.lit(None).cast("string"), "section": F.lit(None).cast("string")})
    return hybrid.embedded(q, "query_id", "query", ["query", "tickers", "ticker", "fiscal_year", "section"])


def test_each_question_searches_its_own_companies(spark):
    c = chunks(spark)
    v, p = hybrid.corpus_vectors(c), plans(spark)
    got = {}
    for r in hybrid.hybrid_per_entity(c, v, p, "tickers", top_k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    want = {1: (["TSLA", "ORCL"], 5), 2: (["IBM"], 10), 3: (COMPANIES, 2), 4: ([None], 10), 5: (["MSFT"], 10)}
    pairs = spark.createDataFrame([(q, 100 * q + k, t) for q, (names, _) in want.items() for k, t in enumerate(names)], "question long, plan long, company string")
    one = p.drop("tickers", "ticker").join(pairs, F.col("query_id") == F.col("question")).drop("query_id", "question").withColumnsRenamed({"plan": "query_id", "company": "ticker"})
    found = {}
    for r in hybrid.hybrid_search(c, v, one, top_k=10).collect():  # a plain search for each company
        question = r.query_id // 100
        if r.rank <= want[question][1]:
            found.setdefault(question, []).append((-round(r.rrf_score, 6), r.chunk_id))
    for question, (names, share) in want.items():
        assert [x for _, x in sorted(got[question])] == [x for _, x in sorted(found[question])][:10]
        assert names == [None] or {x[1].split("-")[0] for x in got[question]} == set(names)


def test_balanced_lists_follow_the_companies_of_the_question(spark):
    c = chunks(spark)
    per = hybrid.expand_entities(plans(spark), "tickers").drop("pos", "entity", "question", "tickers")
    rows = hybrid.balanced_retrieval(hybrid.hybrid_search(c, hybrid.corpus_vectors(c), per, top_k=5), hybrid.STRIDE, 2).orderBy("question", "position").collect()
    names = lambda q: [r.chunk_id.split("-")[0] for r in rows if r.question == q]
    assert names(1) == ["TSLA"] * 2 + ["ORCL"] * 2 and names(2) == ["IBM"] * 2 and names(5) == ["MSFT"] * 2
    assert names(3) == [t for t in COMPANIES for _ in range(2)] and len(names(4)) == 2
