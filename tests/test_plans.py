"""Physical plans: pushdown, early cuts, no needless shuffles. (That no query
holds a cross join is asserted beside its SQL comparison.)"""

import __spark_entry__ as entry
from tests.conftest import SF

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("bm25_search", "knn_cosine", "memory_window", "inject_tables"):
        assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF)), name


def test_filters_reach_the_scan(spark, tmp_path):
    from fathomline.operators import stores
    from fathomline.sources import derived as d

    path = str(tmp_path / "chunks")
    d.text_chunks(spark, SF).write.partitionBy("ticker", "fiscal_year").parquet(path)
    df = stores.scan_chunks_filtered(spark.read.parquet(path), "aapl", fiscal_year="2022", section="General").select("chunk_id")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(ticker" in p and "EqualTo(section,General)" in p and "raw_text" not in p.split("ReadSchema")[1]


def test_row_local_ingestion_does_not_shuffle(spark):
    from pyspark.sql import functions as F

    from fathomline.operators import ingest

    files = spark.range(3).select(F.lit("data/AAPL/10-K/2024/f.html").alias("path"), F.lit("<table></table>").alias("content"))
    docs = ingest.clean_financial_text(ingest.extract_metadata(ingest.parse_filings(files)), "text_content")
    chunks = ingest.chunk_corpus(docs.select("path", "ticker", "fiscal_year", "source_file", "tables", F.col("clean_text").alias("text_content")))
    assert "Exchange" not in plan(chunks)


def test_filings_are_chunked_in_one_pass(spark):
    from fathomline.operators import ingest

    rows = [("p", "AAPL", "2021", "f", "alpha\n| a | b |\n| c | d |\nomega", ["| x |", None, " "]), ("q", "AAPL", "2021", "g", "only text", None)]
    docs = spark.createDataFrame(rows, "path string, ticker string, fiscal_year string, source_file string, text_content string, tables array<string>")
    out = ingest.chunk_corpus(docs)
    got = sorted((r.path, r.chunk_type, r.chunk_index, r.raw_text) for r in out.collect())
    assert got[:2] == [("p", "table", 0, "| x |"), ("p", "table", 3, "| a | b |\n| c | d |")] and got[-1] == ("q", "text", 0, "only text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate") == 1
