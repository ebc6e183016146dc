"""Audit analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import analytics as a
from ..sources import derived as d
from .registry import query

PERF = """count(*) AS total_queries, count(*) FILTER (guardrail_status IN ('passed', 'failed')) AS eligible_queries,
  round(coalesce(avg(total_latency_ms) FILTER (total_latency_ms > 0 AND total_latency_ms <= 600000), 0.0), 1) AS avg_latency_ms, round(coalesce(avg(ttft_ms), 0.0), 1) AS avg_ttft_ms,
  round(count(*) FILTER (cache_hit) * 100.0 / count(*), 1)::DOUBLE AS cache_hit_rate,
  CASE WHEN count(*) FILTER (guardrail_status IN ('passed', 'failed')) = 0 THEN 0.0 ELSE round(count(*) FILTER (guardrail_status = 'passed') * 100.0 / count(*) FILTER (guardrail_status IN ('passed', 'failed')), 1) END::DOUBLE AS guardrail_pass_rate,
  count(total_latency_ms) - count(*) FILTER (total_latency_ms > 0 AND total_latency_ms <= 600000) AS latency_outliers_dropped"""
RECENT = "ts >= (SELECT max(ts) FROM audit_events) - INTERVAL {} DAY"
VALID = "total_latency_ms > 0 AND total_latency_ms <= 600000"


@query("perf_summary", d.sql_with(["audit_events"], f"SELECT {PERF} FROM audit_events WHERE {RECENT.format(7)}"))
def perf_summary(spark, sf):
    return a.perf_summary(d.audit_events(spark, sf), 7)


@query("perf_summary_by_user", d.sql_with(["audit_events"], f"SELECT user_identifier, {PERF} FROM audit_events WHERE {RECENT.format(30)} GROUP BY user_identifier"))
def perf_summary_by_user(spark, sf):
    return a.perf_summary(d.audit_events(spark, sf), 30, ["user_identifier"])


PCT = ", ".join(f"round(quantile_cont(total_latency_ms, {p}), 6) AS {n}" for n, p in (("p50_latency_ms", 0.5), ("p95_latency_ms", 0.95), ("p99_latency_ms", 0.99)))
PCT_COLS = ["p50_latency_ms", "p95_latency_ms", "p99_latency_ms"]


@query("latency_percentiles", d.sql_with(["audit_events"], f"SELECT {PCT} FROM audit_events WHERE {VALID}"))
def latency_percentiles(spark, sf):
    return a.latency_percentiles(d.audit_events(spark, sf)).select(*[F.round(c, 6).alias(c) for c in PCT_COLS])


@query("latency_percentiles_by_status", d.sql_with(["audit_events"], f"SELECT guardrail_status, {PCT} FROM audit_events WHERE {VALID} GROUP BY guardrail_status"))
def latency_percentiles_by_status(spark, sf):
    p = a.latency_percentiles(d.audit_events(spark, sf), None, ["guardrail_status"])
    return p.select("guardrail_status", *[F.round(c, 6).alias(c) for c in PCT_COLS])


@query("context_quality", d.sql_with(["audit_events"], """SELECT round(count(*) FILTER (s >= 0.66) * 100.0 / count(*), 1)::DOUBLE AS high, round(count(*) FILTER (s >= 0.33 AND s < 0.66) * 100.0 / count(*), 1)::DOUBLE AS mid,
    round(count(*) FILTER (s < 0.33) * 100.0 / count(*), 1)::DOUBLE AS low, count(*) AS total FROM (
    SELECT CASE WHEN x <= 0 THEN 0.0 ELSE round(least(greatest((x - 0.4) / 0.45, 0.0), 1.0), 4) END AS s FROM (SELECT unnest([score, score * 0.75]) AS x FROM audit_events) WHERE x IS NOT NULL)"""))
def context_quality(spark, sf):
    raw = F.filter(F.array(F.col("score"), F.col("score") * 0.75), lambda s: s.isNotNull())
    return a.context_quality(d.audit_events(spark, sf).withColumn("scores", F.transform(raw, lambda s: a.audit_score(s))))


@query("volume_by_ticker", d.sql_with(["corpus"], """SELECT t AS ticker, count(chunk_id) AS chunks FROM (SELECT unnest(['AAPL', 'MSFT', 'NVDA', 'TSLA']) AS t) LEFT JOIN corpus ON ticker = t GROUP BY t
    UNION ALL SELECT 'TOTAL', count(*) FROM corpus"""))
def volume_by_ticker(spark, sf):
    return a.volume_by_ticker(d.corpus(spark, sf), [*fixed.SUPPORTED_TICKERS, "TSLA"])


@query("recent_events", d.sql_with(["audit_events"], "SELECT request_id, user_identifier, guardrail_status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM audit_events ORDER BY ts DESC, request_id DESC LIMIT 50"))
def recent_events(spark, sf):
    e = a.recent_events(d.audit_events(spark, sf), 50)
    return e.select("request_id", "user_identifier", "guardrail_status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("recent_events_of_user", d.sql_with(["audit_events"], "SELECT request_id, guardrail_status FROM audit_events WHERE user_identifier = 8 ORDER BY ts DESC, request_id DESC LIMIT 20"))
def recent_events_of_user(spark, sf):
    return a.recent_events(d.audit_events(spark, sf), 20, 8).select("request_id", "guardrail_status")


def results(spark, sf):
    """Answered requests with three retrieved chunks each (some without score)."""
    score = lambda m: (F.col("cents") % m) / 100.0
    ctx = lambda i, s, t, sec: F.struct(
        F.concat(F.lit(f"c{i}-"), F.col("custkey").cast("string")).alias("chunk_id"), s.alias("score"), t.alias("ticker"),
        F.col("fiscal_year").alias("fiscal_year"), F.lit(sec).alias("section"))
    no = F.col("request_id") % 8 == 0
    return d.answers(spark, sf).select(
        "request_id", F.col("custkey").alias("user_identifier"), "asked_at", F.concat(F.lit("Question "), F.col("request_id").cast("string")).alias("query"),
        F.lit(None).cast("string").alias("standalone"), "answer",
        F.when(no, F.array().cast("array<struct<chunk_id:string,score:double,ticker:string,fiscal_year:string,section:string>>")).otherwise(F.array(
            ctx(0, score(100), F.lit("AAPL"), "Item 8 %%TABLE_3%%"), ctx(1, score(70), F.lit(" n/a "), "General"), ctx(2, F.lit(None).cast("double"), F.lit("MSFT"), "Part IV"))).alias("contexts"),
        F.array(F.lit("NVDA - 2026 - Revenue"), F.lit("loose")).alias("citations"),
        F.when(F.col("request_id") % 3 == 0, "passed").when(F.col("request_id") % 3 == 1, "failed").alias("status"),
        (F.col("cents") / 10.0 - 100000.0).alias("latency_ms"), F.lit(None).cast("string").alias("model_used"), (F.col("request_id") % 5 == 0).alias("cache_hit"))


@query("build_audit_events", d.sql_with(["answers"], """SELECT request_id, latency_ms, status, cache_hit, CASE WHEN n = 0 THEN 2 ELSE n END AS retrieved,
    CASE WHEN n = 0 THEN 'NVDA,UNKNOWN' ELSE array_to_string(list_filter([CASE WHEN s0 > 0 THEN 'AAPL' END, CASE WHEN s1 > 0 THEN 'UNKNOWN' END], lambda x: x IS NOT NULL), ',') END AS tags,
    CASE WHEN n = 0 THEN NULL ELSE greatest(CASE WHEN s0 > 0 THEN z0 END, CASE WHEN s1 > 0 THEN z1 END) END AS top, CASE WHEN n = 0 THEN '' WHEN s0 > 0 THEN 'Item 8' ELSE 'General' END AS section
    FROM (SELECT *, CAST((s0 > 0)::INT + (s1 > 0)::INT AS INTEGER) AS n, round(least(greatest((s0 - 0.4) / 0.45, 0.0), 1.0), 4) AS z0, round(least(greatest((s1 - 0.4) / 0.45, 0.0), 1.0), 4) AS z1 FROM (
    SELECT request_id, CASE WHEN request_id % 8 = 0 THEN 0 ELSE (cents % 100) / 100.0::DOUBLE END AS s0, CASE WHEN request_id % 8 = 0 THEN 0 ELSE (cents % 70) / 100.0::DOUBLE END AS s1,
      round(least(greatest(cents / 10.0::DOUBLE - 100000.0, 0.0), 600000.0), 2) AS latency_ms,
      CASE request_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'not_run' END AS status, request_id % 5 = 0 AS cache_hit FROM answers))"""))
def build_audit_events(spark, sf):
    e = a.build_audit_events(results(spark, sf))
    return e.select(
        "request_id", F.col("execution_metadata.total_latency_ms").alias("latency_ms"), F.col("execution_metadata.guardrail_status").alias("status"),
        F.col("execution_metadata.cache_hit").alias("cache_hit"), F.size("retrieved_chunks").alias("retrieved"),
        F.array_join(F.transform("retrieved_chunks", lambda c: c["ticker_tag"]), ",").alias("tags"),
        F.array_max(F.transform("retrieved_chunks", lambda c: c["score"])).alias("top"), F.get("retrieved_chunks", 0)["section"].alias("section"))
