"""Answer and retrieval quality metrics, and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import find_all
from .percentiles import exact_percentiles


# --- judge metrics -----------------------------------------------------------
def supported_share(supported: Column, unsupported: Column) -> Column:
    """Share of supported claims from two arrays; no claims gives zero."""
    s, u = F.coalesce(F.size(supported), F.lit(0)), F.coalesce(F.size(unsupported), F.lit(0))
    return F.coalesce(F.try_divide(s.cast("double"), s + u), F.lit(0.0))


def supported_rate(claims: DataFrame, sample: str, supported: Column) -> DataFrame:
    """The same from one row per claim."""
    return claims.groupBy(sample).agg(F.avg(F.when(supported, 1.0).otherwise(0.0)).alias("score"))


def average_precision(ranks: Column, context_count: Column) -> Column:
    """Rank-aware precision over an array of relevant 1-based ranks."""
    valid = F.array_sort(F.array_distinct(F.filter(ranks, lambda r: (r >= 1) & (r <= context_count))))
    hits = F.transform(valid, lambda r, i: (i + 1).cast("double") / r)
    return F.when(F.size(valid) > 0, F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.size(valid)).otherwise(0.0)


def context_precision(relevant: DataFrame, sample: str, rank: str, context_count: str) -> DataFrame:
    """The same from one row per relevant rank; a sample without one has a row with a
    null rank. Distinct ranks are at most the context count, so the per-sample window stays small."""
    valid = (F.col(rank) >= 1) & (F.col(rank) <= F.col(context_count))
    r = relevant.select(sample, F.when(valid, F.col(rank)).alias("_r")).distinct()
    nth = F.row_number().over(Window.partitionBy(sample).orderBy(F.col("_r").asc_nulls_last()))
    return r.select(sample, (nth / F.col("_r")).alias("_p")).groupBy(sample).agg(F.coalesce(F.avg("_p"), F.lit(0.0)).alias("score"))


def clamp_score(v: Column) -> Column:
    """Into [0, 1]; what is no number stays null."""
    n = v.try_cast("double")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0)))


METRICS = list(fixed.QUALITY_GATES)


def eval_aggregate(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.count(F.lit(1)).alias("sample_count"))


def quality_gate(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per run: each threshold met, all met, and the stage that earns."""
    checks = {m: F.coalesce(F.col(m), F.lit(0.0)) >= t for m, t in fixed.QUALITY_GATES.items()}
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return scores.select(*by, *[c.alias(f"{m}_ok") for m, c in checks.items()], passed.alias("passed"),
                         F.when(passed, "Production").otherwise("Staging").alias("stage"))


# --- contexts and figures ----------------------------------------------------
CONTEXT_JSON = "array<struct<text string, metadata map<string,string>, score double, rerank_score double>>"


def serialize_contexts(contexts: Column) -> Column:
    return F.coalesce(F.to_json(contexts), F.lit("[]"))


def extract_contexts(contexts_json: Column) -> Column:
    """Texts of a serialized context list (objects or plain strings)."""
    objs = F.from_json(contexts_json, CONTEXT_JSON)
    strings = F.from_json(contexts_json, "array<string>")
    texts = F.transform(strings, lambda s, i: F.coalesce(F.when(s.startswith("{"), F.get(objs, i)["text"]).otherwise(s), F.lit("")))
    return F.coalesce(F.filter(texts, lambda t: t != ""), F.array().cast("array<string>"))


def truth_numbers(text: Column) -> Column:
    """Figures a ground truth commits to: decimals, or five and more digits;
    plain years of the filing range are no figures."""
    raw = F.transform(find_all(text, r"\$?([0-9][0-9,]*\.?[0-9]*)", 1), lambda n: F.replace(n, F.lit(","), F.lit("")))
    ok = lambda n: ~n.isin("2023", "2024", "2025", "2026") & (
        n.rlike(r"^\d{5,}$") | (n.contains(".") & n.rlike(r"^\d*\.?\d*$") & n.rlike(r"\d") & (F.length(n) >= 3)))
    return F.array_distinct(F.filter(raw, ok))


def with_plain(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Texts without grouping commas, as columns: stripped once per row, not
    once per figure looked for."""
    return df.withColumns({n: F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")) for n, c in texts.items()})


def figures_missing(truth: str, plain: str) -> Column:
    """Truth figures that do not occur in the (comma-free) text."""
    return F.filter(truth, lambda n: ~F.contains(F.col(plain), n))


def numeric_hit_rate(rows: DataFrame, truth: str, stages: list[str]) -> DataFrame:
    """Share of rows with any truth figure in each stage's text, long form."""
    t = rows.withColumn("_t", truth_numbers(F.col(truth))).where(F.size("_t") > 0)
    t = with_plain(t, {f"_p_{s}": F.col(s) for s in stages})
    aggs = [F.avg((F.size(figures_missing("_t", f"_p_{s}")) < F.size("_t")).cast("double")).alias(s) for s in stages]
    wide = t.agg(F.count(F.lit(1)).alias("total"), *aggs)
    r = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("hit_rate")) for s in stages])).alias("r")
    return wide.select("total", r).select("r.stage", "r.hit_rate", "total")


def context_coverage(rows: DataFrame, key: str, truth: str, context: str) -> DataFrame:
    """Per question: figures wanted, figures missing, fully covered."""
    t = with_plain(rows.withColumn("_t", truth_numbers(F.col(truth))), {"_p": F.col(context)})
    t = t.withColumn("_m", F.size(figures_missing("_t", "_p")))
    return t.select(key, F.size("_t").alias("wanted"), F.col("_m").alias("missing"), (F.col("_m") == 0).alias("covered"))


def answer_correctness(rows: DataFrame, answer: str, expected_numbers: str, expected_tickers: str) -> DataFrame:
    """All expected figures present (commas and blanks ignored); tickers named."""
    text = F.coalesce(F.col(answer), F.lit(""))
    df = rows.withColumns({"_p": F.regexp_replace(F.lower(text), r"[,\s]", ""), "_u": F.upper(text)})
    ok = F.forall(expected_numbers, lambda n: F.contains("_p", F.regexp_replace(n, r"[,\s]", "")))
    df = df.withColumns({"numbers_correct": ok, "tickers_covered": F.filter(expected_tickers, lambda t: F.contains("_u", t))})
    return df.withColumn("coverage_complete", F.size("tickers_covered") == F.size(expected_tickers)).drop("_p", "_u")


# --- runs and rankings -------------------------------------------------------
def rank_overlap(a: DataFrame, b: DataFrame, by: str = "query_id", item: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Two top lists per question: Jaccard, share of b's items in a, same order."""
    both = (
        a.select(by, item, F.col(rank).alias("ra"), F.lit(None).cast("int").alias("rb"))
        .unionByName(b.select(by, item, F.lit(None).cast("int").alias("ra"), F.col(rank).alias("rb")))
        .groupBy(by, item).agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    )
    common = F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull())
    return both.groupBy(by).agg(
        F.round(common / F.count(F.lit(1)), 4).alias("jaccard"),
        F.round(common / F.greatest(F.lit(1), F.count("rb")), 4).alias("overlap"),
        F.bool_and(F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).alias("same_order"))


def latency_by_query(runs: DataFrame, query: str, latency: str, error: Column) -> DataFrame:
    """Mean, median, min, max, deviation and nearest-index p95 per query."""
    r = runs.withColumn("_lat", F.when(~error, F.col(latency)))
    base = r.groupBy(query).agg(
        F.count_if(~error).alias("num_runs"), F.count_if(error).alias("num_errors"), F.avg("_lat").alias("latency_mean_ms"),
        F.min("_lat").alias("latency_min_ms"), F.max("_lat").alias("latency_max_ms"), F.coalesce(F.stddev_samp("_lat"), F.lit(0.0)).alias("latency_std_ms"))
    median = exact_percentiles(r, "_lat", {"latency_median_ms": 0.5}, [query])
    p95 = exact_percentiles(r, "_lat", {"latency_p95_ms": 0.95}, [query], nearest=True)
    return base.join(median, query, "left").join(p95, query, "left")


def compare_configs(a: DataFrame, b: DataFrame, query: str) -> DataFrame:
    """Per query: mean latency of both runs, reduction in percent, answer changed.
    Inputs: query, latency_mean_ms, answer."""
    j = a.select(query, F.col("latency_mean_ms").alias("latency_a_ms"), F.col("answer").alias("_a")).join(
        b.select(query, F.col("latency_mean_ms").alias("latency_b_ms"), F.col("answer").alias("_b")), query, "left")
    lb = F.coalesce("latency_b_ms", F.lit(0.0))
    return j.select(
        query, "latency_a_ms", lb.alias("latency_b_ms"),
        F.when(F.col("latency_a_ms") > 0, (1 - lb / F.col("latency_a_ms")) * 100).otherwise(0.0).alias("latency_reduction_pct"),
        (~F.col("_a").eqNullSafe(F.coalesce("_b", F.lit("")))).alias("answer_changed"))


def status_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def coverage_matrix(results: DataFrame) -> DataFrame:
    """Area x scope grid: some test passed at least in part."""
    ok = F.coalesce(F.bool_or(F.col("status").isin("PASS", "PARTIAL")), F.lit(False))
    return results.groupBy("area").pivot("scope", fixed.COVERAGE_SCOPES).agg(ok.alias("t")).na.fill(False)


def company_comparison(years: DataFrame, company: str, group: str) -> DataFrame:
    """Latest-year growth, R&D share and margin per company, each also scaled to
    100 x value / max(best of the comparison group, 1).

    ``years``: company, group, year, revenue, rd_spend, profit; one row per
    company and year."""
    w = Window.partitionBy(company).orderBy(F.col("year").desc())
    latest = years.withColumns({"_r": F.row_number().over(w), "_prev": F.lead("revenue").over(w)}).where("_r = 1")
    m = latest.select(
        company, group,
        F.when(F.col("_prev") > 0, (F.col("revenue") - F.col("_prev")) / F.col("_prev") * 100).otherwise(0.0).alias("revenue_growth"),
        F.when(F.col("revenue") > 0, F.col("rd_spend") / F.col("revenue") * 100).otherwise(0.0).alias("rd_ratio"),
        F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100).otherwise(0.0).alias("margin"))
    names = ["revenue_growth", "rd_ratio", "margin"]
    best = m.groupBy(group).agg(*[F.greatest(F.max(n), F.lit(1.0)).alias(f"_{n}") for n in names])
    return m.join(best, group).select(company, group, *names, *[(F.col(n) / F.col(f"_{n}") * 100).alias(f"{n}_scaled") for n in names])


def prefilter_ablation(scored: DataFrame, caps: list[int], n: int = fixed.RERANK_TOP_N) -> DataFrame:
    """Cap candidates per question and ticker by fusion rank before scoring;
    overlap of the resulting top n with the uncapped one, per cap."""
    per_ticker = F.row_number().over(Window.partitionBy("query_id", "ticker").orderBy("rank"))
    s = scored.withColumn("_c", per_ticker)
    order = lambda part: Window.partitionBy(*part).orderBy(F.round("rerank_score", 9).desc(), F.col("rank"))
    full = s.withColumn("pos", F.row_number().over(order(["query_id"]))).where(F.col("pos") <= n)
    capped = (
        s.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where(F.col("_c") <= F.col("cap"))
        .withColumn("pos", F.row_number().over(order(["query_id", "cap"]))).where(F.col("pos") <= n)
    )
    hit = capped.join(full.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    size = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    per = hit.groupBy("query_id", "cap").agg(F.count("_hit").alias("kept")).join(size, "query_id")
    return per.groupBy("cap").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("kept") / F.col("_n")).alias("overlap"))


def topn_ablation(scored: DataFrame, large: int = 8, small: int = 6) -> DataFrame:
    """What the smaller top list per (question, ticker) loses against the larger."""
    w = Window.partitionBy("query_id", "ticker").orderBy(F.round("rerank_score", 9).desc(), F.col("rank"))
    s = scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= large)
    in_small = F.col("pos") <= small
    table = F.col("contains_table")
    per = s.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks_large"), F.count_if(in_small).alias("chunks_small"),
        F.count_if(table).alias("tables_large"), F.count_if(table & in_small).alias("tables_small"),
        F.count_distinct("ticker").alias("_t"), F.count_distinct(F.when(in_small, F.col("ticker"))).alias("_ts"))
    return per.withColumn("tickers_kept", F.col("_t") == F.col("_ts")).drop("_t", "_ts")
