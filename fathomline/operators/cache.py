"""The answer cache as a table: keyed entries with expiry and a vector."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.text import trim_ws
from .stores import latest


def query_hash(q: Column) -> Column:
    return F.substring(F.sha2(F.lower(trim_ws(q)), 256), 1, 16)


def namespace(ticker: Column, year: Column) -> Column:
    any_ = F.lit("ANY")
    return F.concat_ws(":", F.lit(fixed.CACHE_NAMESPACE), F.upper(F.coalesce(F.nullif(ticker, F.lit("")), any_)), F.coalesce(F.nullif(year, F.lit("")), any_))


def with_key(df: DataFrame, query: str = "query") -> DataFrame:
    ns = namespace(F.col("ticker"), F.col("fiscal_year"))
    return df.withColumns({"cache_ns": ns, "cache_key": F.concat_ws(":", ns, query_hash(F.col(query)))})


def build_entries(answers: DataFrame, now: str = "asked_at") -> DataFrame:
    """Verified answers -> entries. Filings of supported companies keep a week,
    anything else an hour."""
    lasting = F.upper("ticker").isin(fixed.SUPPORTED_TICKERS) & F.col("fiscal_year").isNotNull()
    ttl = F.when(lasting, fixed.CACHE_TTL_STATIC_SECONDS).otherwise(fixed.CACHE_TTL_SECONDS)
    return with_key(answers).withColumns({
        "query_hash": query_hash(F.col("query")), "ttl_seconds": ttl, "expires_at": F.expr(f"{now} + make_dt_interval(0, 0, 0, ttl_seconds)")})


def live(entries: DataFrame, at: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > at)


def upsert_entries(entries: DataFrame, order: str = "asked_at") -> DataFrame:
    """Last write per key."""
    return latest(entries, ["cache_key"], order)


def invalidate(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")


def flush(entries: DataFrame, ns: str = fixed.CACHE_NAMESPACE) -> DataFrame:
    """Entries left after deleting a namespace."""
    return entries.where(~F.col("cache_key").startswith(f"{ns}:"))


def lookup_exact(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Question -> entry with the same key, not expired, verified."""
    e = entries.select("cache_key", F.col("answer").alias("cached_answer"), "expires_at", "guardrail_passed")
    q = with_key(questions)
    hit = F.col("guardrail_passed") & (F.col("expires_at") > F.col("asked_at"))
    return q.join(e, "cache_key", "left").select(*questions.columns, F.when(hit, F.col("cached_answer")).alias("cached_answer"), F.coalesce(hit, F.lit(False)).alias("hit"))


BLOCK = 20_000
#: bytes of texts and vectors that a block holds, so that long texts do not fill a task
BLOCK_BYTES = 16 << 20
#: questions of a block whose products with a block of entries a task holds at once
ASKED = 256
DECISION = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("best_key", T.StringType()),
    T.StructField("second", T.DoubleType()), T.StructField("second_key", T.StringType()),
])


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    """Default second scorer: share of the question's distinct tokens."""
    q = set(re.findall(fixed.TOKEN_PATTERN, query.lower()))
    return [len(q & set(re.findall(fixed.TOKEN_PATTERN, t.lower()))) / len(q) if q else 0.0 for t in texts]


def _blocks(df: DataFrame, key: str, text: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a block number, and the number of blocks per namespace, so
    that no namespace gathers in one task. Rows and bytes of a block are bounded."""
    held = F.coalesce(F.octet_length(text), F.lit(0)) + 8 * F.size(vector)
    parts = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(held) / BLOCK_BYTES)
    n = df.groupBy("cache_ns").agg(F.ceil(parts).cast("int").alias("n"))
    return df.join(n, "cache_ns").withColumn("own", F.pmod(F.xxhash64(key), F.col("n")).cast("int")).drop("n"), n


def semantic_scores(questions: DataFrame, entries: DataFrame, scorer: Callable[[str, list[str]], list[float]] = overlap_scorer) -> DataFrame:
    """Per question: best cosine among the entries of its namespace and, for the
    gray zone, the best second score among the entries at or above 0.60.

    Entries without a vector take no part, nor do, where the column is there, those that
    are not verified (``guardrail_passed``). With ``expires_at`` and the questions'
    ``asked_at``, a question sees only entries that last beyond its time; without any it
    has no row. Namespaces are cut into blocks of bounded size; a cell multiplies one block
    of questions with one of entries and returns one row per question."""
    timed = "expires_at" in entries.columns and "asked_at" in questions.columns
    if "guardrail_passed" in entries.columns:
        entries = entries.where("guardrail_passed")
    entries, questions = entries.where("embedding IS NOT NULL"), questions.where("embedding IS NOT NULL")
    until, at = ([F.col("expires_at").alias("until")], [F.col("asked_at").alias("at")]) if timed else ([], [])
    e, en = _blocks(entries.select("cache_ns", "cache_key", F.col("query").alias("cached"), F.col("embedding").alias("vec"), *until), "cache_key", "cached", "vec")
    q, qn = _blocks(questions.select("cache_ns", "query_id", F.col("query").alias("asked"), F.col("embedding").alias("asked_vec"), *at), "query_id", "asked", "asked_vec")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = e.withColumnRenamed("own", "eb").join(qn, "cache_ns").select("*", spread("n").alias("qb")).drop("n")
    q = q.withColumnRenamed("own", "qb").join(en, "cache_ns").select("*", spread("n").alias("eb")).drop("n")
    fast, miss = fixed.CACHE_FAST_HIT, fixed.CACHE_FAST_MISS

    def meet(es: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(es) and len(qs):
            es = es.sort_values("cache_key", ignore_index=True)
            texts, keys = es["cached"].to_numpy(), es["cache_key"].to_numpy()
            vecs = np.stack(es["vec"].to_numpy()).astype("float64").T
            for i, (qid, text) in enumerate(zip(qs["query_id"], qs["asked"])):
                if i % ASKED == 0:
                    sims = np.stack(qs["asked_vec"].to_numpy()[i:i + ASKED]).astype("float64") @ vecs
                s = sims[i % ASKED].round(9)
                if timed:
                    lasts = es["until"].to_numpy() > qs["at"].to_numpy()[i]
                    if not lasts.any():
                        continue
                    s = np.where(lasts, s, -np.inf)
                top = int(s.argmax())
                second, key2 = None, None
                gray = np.flatnonzero(s >= miss)
                if len(gray) and s[top] < fast:
                    try:
                        score = np.asarray(scorer(text, [texts[j] for j in gray]), dtype="float64").round(9)
                    except Exception:  # a failing scorer is a miss
                        score = np.zeros(len(gray))
                    order = np.lexsort((keys[gray].astype(str), -score))
                    second, key2 = float(score[order[0]]), keys[gray][order[0]]
                rows.append((qid, float(s[top]), keys[top], second, key2))
        return pd.DataFrame(rows, columns=[f.name for f in DECISION])

    return e.groupBy("cache_ns", "eb", "qb").cogroup(q.groupBy("cache_ns", "eb", "qb")).applyInPandas(meet, DECISION)


def lookup_semantic(questions: DataFrame, entries: DataFrame, scorer: Callable[[str, list[str]], list[float]] = overlap_scorer) -> DataFrame:
    """Best cosine at or above 0.96 hits, below 0.60 misses; in between the
    second scorer's best candidate hits from 0.75. Equal scores: lowest key."""
    parts = semantic_scores(questions, entries, scorer)
    top = lambda v, k: F.min(F.when(F.col(v).isNotNull(), F.struct((-F.col(v)).alias("v"), F.col(k).alias("k"))))
    best = parts.groupBy("query_id").agg(top("best", "best_key").alias("b"), top("second", "second_key").alias("s"))
    j = questions.select("query_id").join(best, "query_id", "left")
    b, s = F.coalesce(-F.col("b.v"), F.lit(-1.0)), F.coalesce(-F.col("s.v"), F.lit(-1.0))
    fast, slow = b >= fixed.CACHE_FAST_HIT, (b >= fixed.CACHE_FAST_MISS) & (s >= fixed.CACHE_SECOND_HIT)
    return j.select("query_id", F.when(fast, "fast").when(slow, "second").otherwise("miss").alias("tier"),
                    F.when(fast, F.col("b.k")).when(slow, F.col("s.k")).alias("cache_key"), F.when(F.col("b").isNotNull(), b).alias("best"))


def lookup(questions: DataFrame, entries: DataFrame, scorer: Callable[[str, list[str]], list[float]] = overlap_scorer) -> DataFrame:
    """What the cache serves: ``exact`` for the live entry of a question's own key, else the
    semantic tiers over the live, verified entries of its namespace. A live entry of the own
    key that is not verified is a miss without a further search.

    ``questions``: query_id, query, ticker, fiscal_year, asked_at, embedding. ``entries``: one
    row a key, with cache_ns, query, embedding, expires_at and guardrail_passed."""
    e = entries.select("cache_key", F.col("expires_at").alias("_until"), F.coalesce("guardrail_passed", F.lit(False)).alias("_passed"))
    met = with_key(questions).join(e, "cache_key", "left").withColumn("_own", F.coalesce(F.col("_until") > F.col("asked_at"), F.lit(False)))
    own = met.where("_own").select("query_id", F.when(F.col("_passed"), "exact").otherwise("miss").alias("tier"), F.when(F.col("_passed"), F.col("cache_key")).alias("cache_key"), F.lit(None).cast("double").alias("best"))
    return own.unionByName(lookup_semantic(met.where("NOT _own"), entries, scorer))
