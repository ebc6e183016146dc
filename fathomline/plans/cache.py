"""Answer-cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as k
from ..operators import dense
from ..sources import derived as d
from . import retrieval as r
from . import verification as ver
from .registry import query

W = d.sql_with


def verified_answers(spark, sf):
    """Cacheable answers with the question they answer (many orders of one
    customer ask the same)."""
    v = ver.verdicts(spark, sf).where("cacheable")
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").cast("long").alias("n"))
    return v.join(c, "custkey").select(
        "request_id", F.concat(F.lit(" Total of Customer "), F.col("custkey").cast("string"), F.lit("? ")).alias("query"),
        F.when(F.col("n") % 5 != 0, F.lower(d.ticker_of(F.col("n")))).alias("ticker"), F.when(F.col("n") % 3 != 0, F.col("fiscal_year")).alias("fiscal_year"),
        "answer", F.col("asked_at"), (F.col("request_id") % 12 != 3).alias("guardrail_passed"))


ENT = f"""{ver.STATUS},
va AS (SELECT request_id, ' Total of Customer ' || custkey || '? ' AS query, CASE WHEN nk % 5 <> 0 THEN lower({d._ticker('nk')}) END AS ticker, CASE WHEN nk % 3 <> 0 THEN fiscal_year END AS fiscal_year, answer, asked_at, request_id % 12 <> 3 AS guardrail_passed
  FROM sta JOIN (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nk FROM customer) ON custkey = c_custkey WHERE status = 'passed' AND NOT contains(lower(answer), 'not available')),
en AS (SELECT *, 'sem_cache:' || upper(coalesce(ticker, 'ANY')) || ':' || coalesce(fiscal_year, 'ANY') || ':' || substr(sha256(lower(trim(query))), 1, 16) AS cache_key,
  CASE WHEN upper(ticker) IN ('AAPL', 'MSFT', 'NVDA') AND fiscal_year IS NOT NULL THEN 604800 ELSE 3600 END AS ttl_seconds FROM va),
up AS (SELECT cache_key, arg_max({{'id': request_id, 'answer': answer, 't': asked_at, 'ttl': ttl_seconds, 'ok': guardrail_passed}}, {{'t': asked_at, 'id': request_id}}) AS e FROM en GROUP BY cache_key)"""


def entries(spark, sf):
    return k.build_entries(verified_answers(spark, sf))


def stored(spark, sf):
    return k.upsert_entries(entries(spark, sf).withColumn("at", F.struct("asked_at", "request_id")), "at")


@query("cache_build_entries", W(["answers"], "SELECT request_id, cache_key, ttl_seconds, strftime(asked_at + ttl_seconds * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS expires_at FROM en", ENT))
def cache_build_entries(spark, sf):
    return entries(spark, sf).select("request_id", "cache_key", "ttl_seconds", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query("cache_upsert", W(["answers"], "SELECT cache_key, e.id AS request_id FROM up", ENT))
def cache_upsert(spark, sf):
    return stored(spark, sf).select("cache_key", "request_id")


@query("cache_lookup_exact", W(["answers"], """SELECT q.request_id, e IS NOT NULL AND e.ok AND e.t + e.ttl * INTERVAL 1 SECOND > q.asked_at + INTERVAL 2 DAY AS hit, CASE WHEN e IS NOT NULL AND e.ok AND e.t + e.ttl * INTERVAL 1 SECOND > q.asked_at + INTERVAL 2 DAY THEN md5(e.answer) END AS cached_md5 FROM (
    SELECT *, 'sem_cache:' || upper(coalesce(ticker, 'ANY')) || ':' || coalesce(fiscal_year, 'ANY') || ':' || substr(sha256(lower(trim(upper(query)))), 1, 16) AS key FROM en) q LEFT JOIN up ON up.cache_key = q.key""", ENT))
def cache_lookup_exact(spark, sf):
    q = verified_answers(spark, sf).select("request_id", F.upper("query").alias("query"), "ticker", "fiscal_year", (F.col("asked_at") + F.expr("interval 2 days")).alias("asked_at"))
    return k.lookup_exact(q, stored(spark, sf)).select("request_id", "hit", F.md5("cached_answer").alias("cached_md5"))


@query("cache_invalidate", W(["answers"], "SELECT cache_key FROM up WHERE cache_key NOT IN (SELECT cache_key FROM en WHERE request_id % 7 = 0)", ENT))
def cache_invalidate(spark, sf):
    return k.invalidate(stored(spark, sf), entries(spark, sf).where("request_id % 7 = 0")).select("cache_key")


@query("cache_flush", W(["answers"], "SELECT cache_key FROM up WHERE NOT starts_with(cache_key, 'sem_cache:AAPL:')", ENT))
def cache_flush(spark, sf):
    return k.flush(stored(spark, sf), "sem_cache:AAPL").select("cache_key")


@query("cache_live_entries", W(["answers"], "SELECT cache_key FROM up WHERE e.t + e.ttl * INTERVAL 1 SECOND > TIMESTAMP '1998-01-01 00:30:00'", ENT))
def cache_live_entries(spark, sf):
    return k.live(stored(spark, sf), F.lit("1998-01-01 00:30:00").cast("timestamp_ntz")).select("cache_key")


def days(number: str):
    return F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(cast({number} as int))")


def vector_entries(spark, sf):
    """Documents as cached questions in their filing's namespace; some have expired, some were never verified."""
    t = d.text_chunks(spark, sf).select(
        "chunk_id", F.col("raw_text").alias("query"), F.when(F.col("doc_id") % 5 < 3, F.col("ticker")).alias("ticker"), F.when(F.col("doc_id") % 2 == 0, F.col("fiscal_year")).alias("fiscal_year"),
        days("doc_id % 13").alias("expires_at"), F.when(F.col("doc_id") % 11 != 5, F.col("doc_id") % 11 != 4).alias("guardrail_passed"))
    e = k.with_key(t.join(dense.hashed_tf(t, "chunk_id", "query"), "chunk_id"))
    return e.withColumn("cache_key", F.col("chunk_id")).drop("chunk_id")


def vector_questions(spark, sf):
    q = d.questions(spark, sf).select("query_id", "query", "ticker", "fiscal_year", days("query_id % 10").alias("asked_at"))
    return k.with_key(q.join(dense.hashed_tf(q, "query_id", "query"), "query_id"))


def cached_questions(spark, sf):
    """Two of three questions as entries of their own key, in capitals; not all live or verified."""
    q = vector_questions(spark, sf).where("query_id % 3 < 2").withColumns({
        "query": F.upper("query"), "expires_at": days("query_id % 7"), "guardrail_passed": F.col("query_id") % 4 != 1})
    return k.upsert_entries(q, "query_id").select("cache_key", "cache_ns", "query", "ticker", "fiscal_year", "embedding", "expires_at", "guardrail_passed")


DAY = "TIMESTAMP '2024-01-01' + ({}) * INTERVAL 1 DAY"
DOC_ENTRIES = f"""SELECT chunk_id, raw_text AS query, coalesce(CASE WHEN doc_id % 5 < 3 THEN ticker END, 'ANY') || ':' || coalesce(CASE WHEN doc_id % 2 = 0 THEN fiscal_year END, 'ANY') AS ns,
  {DAY.format('doc_id % 13')} AS until, doc_id % 11 NOT IN (4, 5) AS ok FROM text_chunks"""
ASKED = f"""cq AS (SELECT query_id, query, ns, asked, 'sem_cache:' || ns || ':' || substr(sha256(lower(trim(query))), 1, 16) AS key FROM (
  SELECT query_id, query, coalesce(ticker, 'ANY') || ':' || coalesce(fiscal_year, 'ANY') AS ns, {DAY.format('query_id % 10')} AS asked FROM questions)),
own AS (SELECT key, arg_max({{'query': upper(query), 'ns': ns, 'until': {DAY.format('query_id % 7')}, 'ok': query_id % 4 <> 1}}, query_id) AS x FROM cq WHERE query_id % 3 < 2 GROUP BY key)"""


def semantic_cte(entries: str) -> str:
    """Best entry and best second score of each question: sm(query_id, tier, cache_key, best)."""
    return f"""{ASKED},
ce AS ({entries}),
{r.vec_cte('e', 'ce', 'chunk_id', 'query')}, {r.vec_cte('q', 'cq', 'query_id', 'query')},
pr AS (SELECT query_id, chunk_id, list_distinct({r.TOK.format('cq.query')}) AS qt, list_distinct({r.TOK.format('ce.query')}) AS et FROM cq JOIN ce USING (ns) WHERE ok AND until > asked AND chunk_id IN (SELECT chunk_id FROM ev)),
dt AS (SELECT query_id, chunk_id, sum(qv.x * ev.x) AS c FROM pr JOIN qv USING (query_id) JOIN ev USING (chunk_id, b) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(coalesce(c, 0), 9) AS c, round(len(list_intersect(qt, et)) / len(qt), 9) AS s FROM pr LEFT JOIN dt USING (query_id, chunk_id)),
sm AS (SELECT query_id, CASE WHEN b >= 0.96 THEN 'fast' WHEN b >= 0.6 AND s2 >= 0.75 THEN 'second' ELSE 'miss' END AS tier,
    CASE WHEN b >= 0.96 THEN k1 WHEN b >= 0.6 AND s2 >= 0.75 THEN k2 END AS cache_key, round(b, 6) AS best FROM questions LEFT JOIN (
    SELECT query_id, max(c) AS b, arg_min(chunk_id, {{'v': -c, 'k': chunk_id}}) AS k1, max(s) FILTER (c >= 0.6) AS s2, arg_min(chunk_id, {{'v': -s, 'k': chunk_id}}) FILTER (c >= 0.6) AS k2 FROM sc GROUP BY query_id) USING (query_id))"""


@query("cache_lookup_semantic", W(["text_chunks", "questions"], "SELECT * FROM sm", semantic_cte(DOC_ENTRIES)))
def cache_lookup_semantic(spark, sf):
    out = k.lookup_semantic(vector_questions(spark, sf), vector_entries(spark, sf))
    return out.select("query_id", "tier", "cache_key", F.round("best", 6).alias("best"))


@query("cache_lookup", W(["text_chunks", "questions"], """SELECT query_id, CASE WHEN x.until > asked THEN CASE WHEN x.ok THEN 'exact' ELSE 'miss' END ELSE tier END AS tier,
    CASE WHEN x.until > asked THEN CASE WHEN x.ok THEN key END ELSE cache_key END AS cache_key, CASE WHEN x.until > asked THEN NULL ELSE best END AS best FROM cq LEFT JOIN own USING (key) JOIN sm USING (query_id)""",
    semantic_cte(DOC_ENTRIES + " UNION ALL SELECT key, x.query, x.ns, x.until, x.ok FROM own")))
def cache_lookup(spark, sf):
    entries = vector_entries(spark, sf).unionByName(cached_questions(spark, sf))
    out = k.lookup(vector_questions(spark, sf), entries)
    return out.select("query_id", "tier", "cache_key", F.round("best", 6).alias("best"))
