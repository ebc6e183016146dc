"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import evaluate as e
from ..sources import derived as d
from ..sources import evalio
from . import retrieval as r
from .registry import query


@query("eval_faithfulness", "SELECT l_orderkey AS sample, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY ALL")
def eval_faithfulness(spark, sf):
    out = e.supported_rate(d.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "sample"), "sample", F.col("l_returnflag") != "R")
    return out.select("sample", F.round("score", 6).alias("score"))


@query("eval_context_recall", "SELECT l_orderkey AS sample, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY ALL")
def eval_context_recall(spark, sf):
    out = e.supported_rate(d.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "sample"), "sample", F.col("l_linestatus") == "F")
    return out.select("sample", F.round("score", 6).alias("score"))


@query("eval_context_precision", """SELECT s.sample, round(coalesce(avg(nth / k), 0), 6) AS score FROM (SELECT DISTINCT l_orderkey AS sample FROM lineitem) s
    LEFT JOIN (SELECT sample, k, row_number() OVER (PARTITION BY sample ORDER BY k) AS nth
    FROM (SELECT DISTINCT l_orderkey AS sample, l_linenumber AS k FROM lineitem WHERE l_quantity < 25 AND l_linenumber BETWEEN 1 AND 5)) r ON r.sample = s.sample GROUP BY s.sample""")
def eval_context_precision(spark, sf):
    relevant = F.when(F.col("l_quantity") < 25, F.col("l_linenumber"))
    rows = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), relevant.alias("l_linenumber"), F.lit(5).alias("contexts"))
    return e.context_precision(rows, "sample", "l_linenumber", "contexts").select("sample", F.round("score", 6).alias("score"))


def samples(spark, sf):
    """Metric columns per order, grouped into runs by priority."""
    o = d.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("run"), e.clamp_score(((80 + k % 30) / 100.0).cast("string")).alias("faithfulness"),
        e.clamp_score(F.when(k % 50 != 0, ((70 + k % 31) / 100.0).cast("string")).otherwise("bad")).alias("answer_relevance"),
        ((60 + k % 41) / 100.0).alias("context_precision"), ((65 + k % 37) / 100.0).alias("context_recall"))


SAMPLES = """samples AS (SELECT o_orderpriority AS run, least((80 + o_orderkey % 30) / 100.0::DOUBLE, 1.0) AS faithfulness, CASE WHEN o_orderkey % 50 <> 0 THEN (70 + o_orderkey % 31) / 100.0::DOUBLE END AS answer_relevance,
  (60 + o_orderkey % 41) / 100.0::DOUBLE AS context_precision, (65 + o_orderkey % 37) / 100.0::DOUBLE AS context_recall FROM orders),
agg AS (SELECT run, avg(faithfulness) AS faithfulness, avg(answer_relevance) AS answer_relevance, avg(context_precision) AS context_precision, avg(context_recall) AS context_recall, count(*) AS sample_count FROM samples GROUP BY run)"""


@query("eval_aggregate", f"WITH {SAMPLES} SELECT run, sample_count, {', '.join(f'round({m}, 6) AS {m}' for m in e.METRICS)} FROM agg")
def eval_aggregate(spark, sf):
    return e.eval_aggregate(samples(spark, sf), ["run"]).select("run", "sample_count", *[F.round(m, 6).alias(m) for m in e.METRICS])


GATE = " AND ".join(f"{m} >= {t}" for m, t in fixed.QUALITY_GATES.items())


@query("quality_gate", f"WITH {SAMPLES} SELECT run, {', '.join(f'{m} >= {t} AS {m}_ok' for m, t in fixed.QUALITY_GATES.items())}, {GATE} AS passed, CASE WHEN {GATE} THEN 'Production' ELSE 'Staging' END AS stage FROM agg")
def quality_gate(spark, sf):
    return e.quality_gate(e.eval_aggregate(samples(spark, sf), ["run"]), ["run"])


@query("extract_contexts", "SELECT doc_id, CASE WHEN text = '' THEN 1 ELSE 2 END AS texts, md5(text) AS text_md5 FROM documents")
def extract_contexts(spark, sf):
    """Serialize whole texts as a context list and read it back."""
    ctx = lambda t: F.struct(t.alias("text"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.lit(0.5).alias("score"))
    docs = d.table(spark, sf, "documents").select("doc_id", e.serialize_contexts(F.array(ctx(F.col("text")), ctx(F.lit("")), ctx(F.lit("tail")))).alias("contexts"))
    texts = docs.select("doc_id", e.extract_contexts(F.col("contexts")).alias("t"))
    return texts.select("doc_id", F.size("t").alias("texts"), F.md5(F.when(F.size("t") == 2, F.get("t", 0)).otherwise("")).alias("text_md5"))


TRUTH = r"""list_distinct(list_filter(list_transform(regexp_extract_all({}, '\$?([0-9][0-9,]*\.?[0-9]*)', 1), lambda n: replace(n, ',', '')),
    lambda n: n NOT IN ('2023', '2024', '2025', '2026') AND (regexp_full_match(n, '\d{{5,}}') OR (contains(n, '.') AND regexp_full_match(n, '\d*\.?\d*') AND length(n) >= 3))))"""
MISSING = "list_filter({0}, lambda n: NOT contains(replace(coalesce({1}, ''), ',', ''), n))"


@query("numeric_hit_rate", d.sql_with(["answers"], f"""SELECT stage, total, round(hit_rate, 6) AS hit_rate FROM (
    SELECT 'answer' AS stage, count(*) AS total, avg((len({MISSING.format('t', 'answer')}) < len(t))::INT) AS hit_rate FROM (SELECT *, {TRUTH.format('answer')} AS t FROM answers) WHERE len(t) > 0
    UNION ALL SELECT 'extracted_raw_data', count(*), avg((len({MISSING.format('t', 'extracted_raw_data')}) < len(t))::INT) FROM (SELECT *, {TRUTH.format('answer')} AS t FROM answers) WHERE len(t) > 0)"""))
def numeric_hit_rate(spark, sf):
    out = e.numeric_hit_rate(d.answers(spark, sf), "answer", ["answer", "extracted_raw_data"])
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@query("context_coverage", d.sql_with(["answers"], f"""SELECT request_id, CAST(len(t) AS INTEGER) AS wanted, CAST(len({MISSING.format('t', 'extracted_raw_data')}) AS INTEGER) AS missing, len({MISSING.format('t', 'extracted_raw_data')}) = 0 AS covered
    FROM (SELECT *, {TRUTH.format('answer')} AS t FROM answers)"""))
def context_coverage(spark, sf):
    return e.context_coverage(d.answers(spark, sf), "request_id", "answer", "extracted_raw_data")


@query("answer_correctness", d.sql_with(["answers"], r"""SELECT request_id, contains(p, '12.5') AND contains(p, replace(w, ',', '')) AS numbers_correct, CASE WHEN contains(u, 'SALES') THEN 1 ELSE 0 END + CASE WHEN contains(u, 'REVENUE') THEN 1 ELSE 0 END AS covered
    FROM (SELECT *, regexp_replace(lower(answer), '[,\s]', '', 'g') AS p, upper(answer) AS u, format('{:,}', cents // 100) AS w FROM answers)"""))
def answer_correctness(spark, sf):
    a = d.answers(spark, sf).withColumns({
        "nums": F.array(F.lit("12.5"), F.format_number(F.floor(F.col("cents") / 100), 0)), "names": F.array(F.lit("SALES"), F.lit("REVENUE"))})
    return e.answer_correctness(a, "answer", "nums", "names").select("request_id", "numbers_correct", F.size("tickers_covered").alias("covered"))


@query("rank_overlap", r.with_q("""SELECT query_id, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 4) AS jaccard, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / greatest(1, count(rb)), 4) AS overlap,
    bool_and(coalesce(ra = rb, FALSE)) AS same_order FROM (SELECT query_id, chunk_id, max(CASE WHEN family = 'dense' THEN rank END) AS ra, max(CASE WHEN family = 'sparse' THEN rank END) AS rb FROM hlists WHERE rank <= 8 GROUP BY ALL) GROUP BY query_id""",
    r.hybrid_cte("h", "questions", 40)))
def rank_overlap(spark, sf):
    both = r.lists(spark, sf).where("rank <= 8")
    return e.rank_overlap(both.where("family = 'dense'"), both.where("family = 'sparse'"))


def runs(spark, sf):
    return d.audit_events(spark, sf).withColumn("query_id", F.col("user_identifier"))


@query("latency_by_query", d.sql_with(["audit_events"], """SELECT query_id, num_runs, num_errors, round(m, 6) AS latency_mean_ms, lo AS latency_min_ms, hi AS latency_max_ms, round(coalesce(sd, 0.0), 6) AS latency_std_ms, round(med, 6) AS latency_median_ms,
    list_extract(l, CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT) + 1) AS latency_p95_ms FROM (
    SELECT user_identifier AS query_id, count(*) FILTER (NOT err) AS num_runs, count(*) FILTER (err) AS num_errors, avg(lat) AS m, min(lat) AS lo, max(lat) AS hi, stddev_samp(lat) AS sd, quantile_cont(lat, 0.5) AS med, list_sort(list(lat) FILTER (lat IS NOT NULL)) AS l
    FROM (SELECT *, guardrail_status = 'failed' AS err, CASE WHEN guardrail_status <> 'failed' THEN total_latency_ms END AS lat FROM audit_events) GROUP BY user_identifier)"""))
def latency_by_query(spark, sf):
    out = e.latency_by_query(runs(spark, sf), "query_id", "total_latency_ms", F.col("guardrail_status") == "failed")
    return out.select("query_id", "num_runs", "num_errors", "latency_min_ms", "latency_max_ms", "latency_p95_ms",
                      *[F.round(c, 6).alias(c) for c in ("latency_mean_ms", "latency_std_ms", "latency_median_ms")])


@query("compare_configs", d.sql_with(["audit_events"], """SELECT query_id, round(a, 6) AS latency_a_ms, round(coalesce(b, 0.0), 6) AS latency_b_ms, round(CASE WHEN a > 0 THEN (1 - coalesce(b, 0.0) / a) * 100 ELSE 0.0 END, 6) AS latency_reduction_pct, NOT (xa = coalesce(xb, '')) AS answer_changed FROM (
    SELECT user_identifier AS query_id, avg(ttft_ms) FILTER (cache_hit) AS b, avg(ttft_ms) FILTER (NOT cache_hit) AS a, max(guardrail_status) FILTER (NOT cache_hit) AS xa, max(guardrail_status) FILTER (cache_hit) AS xb FROM audit_events GROUP BY ALL) WHERE xa IS NOT NULL"""))
def compare_configs(spark, sf):
    agg = lambda hit: runs(spark, sf).where(F.col("cache_hit") == hit).groupBy("query_id").agg(
        F.avg("ttft_ms").alias("latency_mean_ms"), F.max("guardrail_status").alias("answer"))
    out = e.compare_configs(agg(False), agg(True), "query_id")
    return out.select("query_id", "answer_changed", *[F.round(c, 6).alias(c) for c in ("latency_a_ms", "latency_b_ms", "latency_reduction_pct")])


@query("prefilter_ablation", r.with_q("""SELECT cap, count(*) AS queries, round(avg(kept / n), 6) AS overlap FROM (
    SELECT f.query_id, cap, count(g.chunk_id) AS kept, any_value(n) AS n FROM (SELECT query_id, count(*) AS n FROM hrr GROUP BY ALL) f
      JOIN capped g0 ON g0.query_id = f.query_id LEFT JOIN hrr g ON g.query_id = g0.query_id AND g.chunk_id = g0.chunk_id GROUP BY ALL) GROUP BY cap""",
    r.HY + """,
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cap ORDER BY round(rerank_score, 9) DESC, rank) AS pos FROM (
  SELECT *, unnest([33, 30, 27]) AS cap FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ticker ORDER BY rank) AS c FROM hrr0)) WHERE c <= cap) WHERE pos <= 8)"""))
def prefilter_ablation(spark, sf):
    return e.prefilter_ablation(r.scored(spark, sf), fixed.PREFILTER_CAPS).withColumn("overlap", F.round("overlap", 6))


@query("topn_ablation", r.with_q("""SELECT query_id, count(*) AS chunks_large, count(*) FILTER (pos <= 6) AS chunks_small, count(*) FILTER (contains_table) AS tables_large, count(*) FILTER (contains_table AND pos <= 6) AS tables_small,
    count(DISTINCT ticker) = count(DISTINCT CASE WHEN pos <= 6 THEN ticker END) AS tickers_kept FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, ticker ORDER BY round(rerank_score, 9) DESC, rank) AS pos FROM hrr0) WHERE pos <= 8 GROUP BY query_id""", r.HY))
def topn_ablation(spark, sf):
    return e.topn_ablation(r.scored(spark, sf))


def audit_results(spark, sf):
    scope = F.element_at(F.array(*[F.lit(s) for s in fixed.COVERAGE_SCOPES]), (F.col("user_id") % 8 + 1).cast("int"))
    return d.table(spark, sf, "events").select(
        F.concat_ws(" ", "event_type", F.date_format("ts", "dd")).alias("area"), scope.alias("scope"),
        F.when(F.col("event_id") % 37 == 0, "PASS").when(F.col("event_id") % 41 == 0, "PARTIAL").otherwise("FAIL").alias("status"))


AUDIT = f"""res AS (SELECT event_type || ' ' || strftime(ts, '%d') AS area, list_extract({fixed.COVERAGE_SCOPES}, CAST(user_id % 8 AS BIGINT) + 1) AS scope,
  CASE WHEN event_id % 37 = 0 THEN 'PASS' WHEN event_id % 41 = 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM events)"""


@query("status_summary", f"WITH {AUDIT} SELECT status, count(*) AS n FROM res GROUP BY status")
def status_summary(spark, sf):
    return e.status_summary(audit_results(spark, sf))


@query("coverage_matrix", f"""WITH {AUDIT} SELECT area, {', '.join(f"coalesce(bool_or(status IN ('PASS', 'PARTIAL')) FILTER (scope = '{s}'), FALSE) AS \"{s}\"" for s in fixed.COVERAGE_SCOPES)} FROM res GROUP BY area""")
def coverage_matrix(spark, sf):
    return e.coverage_matrix(audit_results(spark, sf))


def company_years(spark, sf):
    o, c = d.table(spark, sf, "orders"), d.table(spark, sf, "customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_custkey").alias("company"), F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"))
        .agg(F.sum(cents).alias("revenue"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", cents)), F.lit(0)).alias("rd_spend"),
             F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", cents)), F.lit(0)).alias("profit"))
    )


@query("company_comparison", """WITH y AS (SELECT c_custkey AS company, c_mktsegment AS segment, year(o_orderdate) AS year, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS rev,
    coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END), 0) AS rd, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END), 0) AS pr
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  l AS (SELECT *, row_number() OVER w AS r, lead(rev) OVER w AS prev FROM y WINDOW w AS (PARTITION BY company ORDER BY year DESC)),
  m AS (SELECT company, segment, CASE WHEN prev > 0 THEN (rev - prev) / prev * 100 ELSE 0.0 END::DOUBLE AS revenue_growth, rd::DOUBLE / rev * 100 AS rd_ratio, pr::DOUBLE / rev * 100 AS margin FROM l WHERE r = 1)
  SELECT company, segment, round(revenue_growth, 4) AS revenue_growth, round(rd_ratio, 4) AS rd_ratio, round(margin, 4) AS margin, round(revenue_growth / g * 100, 4) AS revenue_growth_scaled, round(rd_ratio / d * 100, 4) AS rd_ratio_scaled, round(margin / p * 100, 4) AS margin_scaled
  FROM m JOIN (SELECT segment, greatest(max(revenue_growth), 1.0) AS g, greatest(max(rd_ratio), 1.0) AS d, greatest(max(margin), 1.0) AS p FROM m GROUP BY segment) USING (segment)""")
def company_comparison(spark, sf):
    out = e.company_comparison(company_years(spark, sf), "company", "segment")
    nums = [c for c in out.columns if c not in ("company", "segment")]
    return out.select("company", "segment", *[F.round(c, 4).alias(c) for c in nums])


# --- evaluation files --------------------------------------------------------
@query("read_eval_dataset", "SELECT md5(text) AS question, length(text) AS truth_chars FROM benchmark WHERE item_id % 9 <> 0")
def read_eval_dataset(spark, sf):
    """Questions to CSV and back, rows without ground truth dropped."""
    b = d.table(spark, sf, "benchmark").select(F.col("text").alias("question"), F.when(F.col("item_id") % 9 != 0, F.col("text")).alias("ground_truth"))
    path = evalio.write_csv(b, "eval-dataset")
    back = evalio.read_eval_dataset(spark, path)
    return back.select(F.md5("question").alias("question"), F.length("ground_truth").cast("long").alias("truth_chars"))


@query("write_eval_trace", """SELECT request_id AS pipeline_run_id, md5(answer) AS answer, CASE WHEN extracted_raw_data IS NULL THEN 0 ELSE 1 END AS contexts FROM (SELECT CAST(request_id AS VARCHAR) AS request_id, answer, extracted_raw_data FROM (
    """ + d.sql_with(["answers"], "SELECT * FROM answers") + """))""")
def write_eval_trace(spark, sf):
    """Evaluation traces with contexts as JSON, written and read in fixed column order."""
    a = d.answers(spark, sf)
    ctx = F.when(F.col("extracted_raw_data").isNull(), F.array().cast("array<struct<text:string,score:double>>")).otherwise(
        F.array(F.struct(F.col("extracted_raw_data").alias("text"), F.lit(1.0).alias("score"))))
    trace = a.select(
        F.lit("q").alias("question"), F.lit("t").alias("ground_truth"), e.serialize_contexts(ctx).alias("contexts"), "answer",
        F.lit("m").alias("model_used"), F.col("request_id").cast("string").alias("pipeline_run_id"))
    back = evalio.read_trace(spark, evalio.write_eval_trace(trace))
    return back.select("pipeline_run_id", F.md5("answer").alias("answer"), F.size(e.extract_contexts(F.col("contexts"))).alias("contexts"))


@query("read_eval_scores", """SELECT CASE WHEN item_id % 2 = 0 THEN item_id / 100.0::DOUBLE ELSE 0.5 END AS faithfulness, CASE WHEN item_id % 3 = 0 THEN item_id + 5 ELSE 2 END AS sample_count,
    CASE WHEN item_id % 2 = 0 THEN 'unknown' ELSE 'judge' END AS judge_model FROM benchmark""")
def read_eval_scores(spark, sf):
    """Score files of both layouts (nested aggregates or flat)."""
    i = F.col("item_id")
    nested = F.struct((i / 100.0).alias("faithfulness"), F.lit(0.9).alias("answer_relevance"))
    doc = F.to_json(F.struct(
        F.when(i % 2 == 0, nested).alias("aggregate_scores"), F.when(i % 2 == 1, 0.5).alias("faithfulness"),
        F.when(i % 3 == 0, i + 5).alias("sample_count"), F.array(F.struct(i.alias("id")), F.struct(i.alias("id"))).alias("samples"),
        F.when(i % 2 == 1, "judge").alias("judge_model")))
    path = evalio.write_json_lines(d.table(spark, sf, "benchmark").select(doc.alias("value")), "eval-scores")
    return evalio.read_eval_scores(spark, path).select("faithfulness", F.col("sample_count").cast("long").alias("sample_count"), "judge_model")
