"""Answers over all companies are checked against the evidence of each."""

from pyspark.sql import functions as F

from fathomline.operators import verify

BY = ["ticker", "fiscal_year"]


def tables(spark):
    answers = [
        (1, "ALL", "2024", "Revenue was $391,035 and $245,122.", "How much?"),
        (2, "ALL", "2024", "The information is not available in the provided reports.", "How much?"),
        (3, "ALL", "2024", "Revenue was $391,035 and $77,777.", "How much?"),
        (4, "ALL", "2031", "", "How much?"),
        (5, "ALL", "2024", "Revenue was $55,555 and $77,777.", "How much?"),
        (6, "AAPL", "2024", "AAPL revenue was $391,035.", "How much?"),
        (7, "AAPL", "2024", "AAPL revenue was $245,122.", "How much?"),
    ]
    chunks = [("a", "AAPL", "2024", "Revenue was $391,035 in the year"), ("m", "MSFT", "2024", "Revenue was $245,122 in the year"), ("t", "TSLA", "2031", "nothing")]
    c = spark.createDataFrame(chunks, "chunk_id string, ticker string, fiscal_year string, raw_text string")
    return spark.createDataFrame(answers, "request_id long, ticker string, fiscal_year string, answer string, query string"), c


def test_status(spark):
    answers, c = tables(spark)
    got = {r.request_id: (r.status, r.layer) for r in verify.grounding_status(answers, c, c, BY).collect()}
    assert got == {1: ("PASS", ""), 2: ("FAIL", "Generation"), 3: got[3], 4: ("PASS", ""), 5: ("FAIL", "Retrieval"), 6: ("PASS", ""), 7: ("FAIL", "Retrieval")}
    assert got[3][0] in ("PASS", "PARTIAL")  # half of the claims and more: the lower thresholds of ALL


def test_class(spark):
    answers, c = tables(spark)
    c = c.withColumn("raw_text", F.replace("raw_text", F.lit(","), F.lit("")))  # terms are compared without commas
    got = {r.request_id: r.label for r in verify.grounding_class(answers, c, c, BY).collect()}
    assert got[1] == "FULLY_GROUNDED" and got[2] == "RETRIEVAL_FAILURE" and got[4] == "CORRECT_REFUSAL" and got[6] == "FULLY_GROUNDED"
