"""Audit-log analytics: single-pass aggregations over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import clean_label
from .percentiles import exact_percentiles


def valid_latency(v: Column) -> Column:
    """Latency or null when missing, not positive, or beyond ten minutes."""
    return F.when((v > 0) & (v <= fixed.MAX_LATENCY_MS), v)


def clamp_latency(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(fixed.MAX_LATENCY_MS))


def audit_score(raw: Column, floor: float = fixed.AUDIT_SCORE_FLOOR, ceil: float = fixed.AUDIT_SCORE_CEIL) -> Column:
    """Rescale a similarity to [0, 1] over the realistic band."""
    v = F.coalesce(raw.cast("double"), F.lit(0.0))
    scaled = (v - floor) / (ceil - floor) if ceil > floor else v
    return F.when(v <= 0, 0.0).otherwise(F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), 4))


def recent_days(events: DataFrame, days: int | None) -> DataFrame:
    """Events of the last ``days`` before the newest one."""
    if days is None:
        return events
    newest = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") >= newest - F.expr(f"interval {int(days)} days"))


def _pct(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), 1)


#: of a value in an exact sum; others (not finite, or of 10^12 and more) are added up as doubles
EXACT = "decimal(20,8)"


def _exact(v: Column) -> Column:
    return v.cast("double").try_cast(EXACT)


def _mean(total: Column, exact: Column, n_exact: Column, n: Column) -> Column:
    """total / n to one decimal, half up; 0 for n = 0. Where every value has a place in the exact
    sum, halves are exact, so that the order in which rows are added decides nothing."""
    tenths = F.call_function("div", F.abs(exact) * F.lit(20) + n, F.greatest(n, F.lit(1)) * F.lit(2))
    plain = F.round(F.try_divide(total, n), 1)
    return F.when(n == 0, 0.0).when(n_exact == n, F.signum(exact.cast("double")) * tenths / F.lit(10.0)).otherwise(plain)


def _mean_of(v: Column) -> Column:
    return _mean(F.sum(v.cast("double")), F.sum(_exact(v)), F.count(_exact(v)), F.count(v))


def perf_measures() -> list[Column]:
    """The metrics of one group of events (batch and streaming share them)."""
    lat = F.col("total_latency_ms")
    passed = F.count_if(F.col("guardrail_status") == "passed")
    eligible = F.count_if(F.col("guardrail_status").isin("passed", "failed"))
    n = F.count(F.lit(1))
    return [
        n.alias("total_queries"), eligible.alias("eligible_queries"),
        _mean_of(valid_latency(lat)).alias("avg_latency_ms"), _mean_of(F.col("ttft_ms")).alias("avg_ttft_ms"),
        _pct(F.count_if("cache_hit"), n).alias("cache_hit_rate"), _pct(passed, eligible).alias("guardrail_pass_rate"),
        (F.count(lat) - F.count(valid_latency(lat))).alias("latency_outliers_dropped"),
    ]


#: size of a latency sketch: ranks are off by about 0.01 %
SKETCH_K = 16_384


def perf_parts() -> list[Column]:
    """What ``perf_from_parts`` adds up: counts, sums and a latency sketch of some events."""
    lat, status = F.col("total_latency_ms"), F.col("guardrail_status")
    valid = valid_latency(lat)
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(status.isin("passed", "failed")).alias("eligible"), F.count_if(status == "passed").alias("passed"),
        F.count(lat).alias("timed"), F.count(valid).alias("valid"), F.sum(valid.cast("double")).alias("latency"), F.count("ttft_ms").alias("firsts"),
        F.sum(F.col("ttft_ms").cast("double")).alias("first"), F.sum(_exact(valid)).alias("exact_latency"), F.count(_exact(valid)).alias("exact_valid"),
        F.sum(_exact(F.col("ttft_ms"))).alias("exact_first"), F.count(_exact(F.col("ttft_ms"))).alias("exact_firsts"), F.count_if("cache_hit").alias("hits"), F.kll_sketch_agg_double(valid.cast("double"), SKETCH_K).alias("sketch"),
    ]


def perf_from_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of ``perf_measures`` and three percentiles (null without a valid latency)."""
    sums = ("n", "eligible", "passed", "timed", "valid", "latency", "firsts", "first", "exact_valid", "exact_firsts", "hits")
    whole = [F.sum(c).cast("decimal(30,8)").alias(c) for c in ("exact_latency", "exact_first")]
    t = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *whole, F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))

    def mean(total: str, n: str) -> Column:
        return _mean(F.col(total), F.col(f"exact_{total}"), F.col(f"exact_{n}"), F.col(n))

    quantiles = [F.when(F.col("valid") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(f"p{round(q * 100)}_latency_ms") for q in (0.5, 0.95, 0.99)]
    return t.select(
        *by, F.col("n").alias("total_queries"), F.col("eligible").alias("eligible_queries"), mean("latency", "valid").alias("avg_latency_ms"), mean("first", "firsts").alias("avg_ttft_ms"),
        _pct(F.col("hits"), F.col("n")).alias("cache_hit_rate"), _pct(F.col("passed"), F.col("eligible")).alias("guardrail_pass_rate"),
        (F.col("timed") - F.col("valid")).alias("latency_outliers_dropped"), *quantiles)


def perf_summary(events: DataFrame, days: int | None = 30, by: list[str] | None = None) -> DataFrame:
    return recent_days(events, days).groupBy(*(by or [])).agg(*perf_measures())


def latency_percentiles(events: DataFrame, days: int | None = None, by: list[str] | None = None) -> DataFrame:
    e = recent_days(events, days).withColumn("_lat", valid_latency(F.col("total_latency_ms")))
    return exact_percentiles(e, "_lat", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}, by)


def context_quality(events: DataFrame, scores: str = "scores", days: int | None = None) -> DataFrame:
    """Share of retrieved chunks per score band; ``scores`` is an array column."""
    s = recent_days(events, days).select(F.explode(scores).alias("s")).where("s is not null")
    n = F.count(F.lit(1))
    high, mid = F.col("s") >= fixed.CONTEXT_HIGH, F.col("s") >= fixed.CONTEXT_MID
    return s.agg(
        _pct(F.count_if(high), n).alias("high"), _pct(F.count_if(mid & ~high), n).alias("mid"),
        _pct(F.count_if(~mid), n).alias("low"), n.alias("total"))


def volume_by_ticker(chunks: DataFrame, tickers: list[str]) -> DataFrame:
    """Chunks per supported ticker (zero when absent) and in total, one pass."""
    measures = [F.count(F.lit(1)).alias("TOTAL"), *[F.count_if(F.col("ticker") == t).alias(t) for t in tickers]]
    names = ["TOTAL", *tickers]
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("ticker"), F.col(n).alias("chunks")) for n in names])).alias("r")
    return chunks.agg(*measures).select(stack).select("r.ticker", "r.chunks")


def recent_events(events: DataFrame, limit: int = 50, user: object | None = None) -> DataFrame:
    """Newest events; the limit is the feature (a top-n report)."""
    e = events if user is None else events.where(F.col("user_identifier") == F.lit(user))
    return e.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(limit)


def build_audit_events(results: DataFrame) -> DataFrame:
    """Requests with their results -> nested audit rows.

    ``results``: request_id, user_identifier, asked_at, query, answer, contexts
    ARRAY<STRUCT<chunk_id, score, ticker, fiscal_year, section>>, citations
    ARRAY<STRING>, status, latency_ms, model_used. Chunks without a score are
    left out; with none left, the cited strings stand in."""
    scored = F.filter("contexts", lambda c: F.coalesce(c["score"], F.lit(0.0)) > 0)
    kept = F.transform(scored, lambda c: F.struct(
        F.coalesce(c["chunk_id"], F.lit("")).alias("chunk_id"), audit_score(c["score"]).alias("score"),
        clean_label(c["ticker"]).alias("ticker"), clean_label(c["fiscal_year"]).alias("fiscal_year"), clean_label(c["section"]).alias("section"),
        F.coalesce(F.nullif(clean_label(c["ticker"]), F.lit("")), F.lit(fixed.UNKNOWN)).alias("ticker_tag")))
    cited = F.transform(F.coalesce("citations", F.array().cast("array<string>")), lambda s: F.struct(
        s.alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit("").alias("ticker"), F.lit("").alias("fiscal_year"), F.lit("").alias("section"),
        F.when(s.contains(" - "), F.split(s, " - ")[0]).otherwise(fixed.UNKNOWN).alias("ticker_tag")))
    return results.select(
        "request_id", F.col("asked_at").alias("timestamp"), "user_identifier",
        F.struct(F.col("query").alias("raw"), F.coalesce("standalone", "query").alias("standalone")).alias("user_query"),
        F.when(F.size(kept) > 0, kept).otherwise(cited).alias("retrieved_chunks"),
        F.struct(F.col("answer")).alias("generated_response"),
        F.struct(
            F.round(clamp_latency(F.col("latency_ms")), 2).alias("total_latency_ms"), F.coalesce("model_used", F.lit("unknown")).alias("model_used"),
            F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), F.coalesce("status", F.lit("not_run")).alias("guardrail_status"),
        ).alias("execution_metadata"),
    )
