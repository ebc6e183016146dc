"""Hybrid retrieval: dense and BM25 lists fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import any_of
from .dense import BROADCAST_QUESTIONS, hashed_tf, knn_hits
from .scopes import PARTS
from .sparse import bm25_search, rank_top


def ranked_lists(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    cols = ["query_id", "chunk_id", "rank", "score"]
    return (
        dense.select(*cols, F.lit("dense").alias("family"))
        .unionByName(sparse.select(*cols, F.lit("sparse").alias("family")))
    )


def rrf_fuse(lists: DataFrame, dense_weight: float = 1.0, sparse_weight: float = 1.0, k: int = fixed.RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) over all lists (ranks from 1), with the best
    score per family from the same aggregation."""
    weight = F.when(F.col("family") == "dense", dense_weight).otherwise(sparse_weight)
    return lists.groupBy("query_id", "chunk_id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("rrf_score"),
        F.max(F.when(F.col("family") == "dense", F.col("score"))).alias("dense_score"),
        F.max(F.when(F.col("family") == "sparse", F.col("score"))).alias("sparse_score"),
    )


def rescue_tables(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """Best table chunk (BM25 over the scope's tables, positive score) for the
    questions that ask about segments."""
    asking = plans.where(any_of(F.lower("query"), fixed.SEGMENT_KEYWORDS))
    return bm25_search(chunks.where("contains_table"), asking, 1, positive=True).select("query_id", "chunk_id", "score")


def fuse_and_cut(lists: DataFrame, rescued: DataFrame, k: int) -> DataFrame:
    """RRF, rescue boost, top k."""
    boost = rescued.select("query_id", "chunk_id", F.lit(fixed.TABLE_RESCUE_BOOST).alias("boost"))
    fused = rrf_fuse(lists).join(boost, ["query_id", "chunk_id"], "full_outer")
    fused = fused.withColumn("rrf_score", F.greatest(F.coalesce("rrf_score", F.lit(0.0)), F.coalesce("boost", F.lit(0.0))))
    top = rank_top(fused.drop("boost"), k, ["query_id"], score="rrf_score")
    return top.withColumn("rescued_table", F.col("rrf_score") >= fixed.TABLE_RESCUE_BOOST)


def hybrid_search(
    chunks: DataFrame, vectors: DataFrame, plans: DataFrame,
    candidate_k: int = fixed.CANDIDATE_K, top_k: int = fixed.HYBRID_TOP_K, corpus: DataFrame | None = None,
) -> DataFrame:
    """Filter, dense and sparse top lists, fusion, rescue, cut, text lookup.

    ``plans``: query_id, query, embedding and filter columns. Rows whose text is
    missing from ``chunks`` are dropped after the cut. ``corpus`` (default
    ``chunks``) is what BM25 searches."""
    corpus = chunks if corpus is None else corpus
    text_plans = plans.drop("embedding")
    lists = ranked_lists(knn_hits(vectors, plans.drop("query"), candidate_k), bm25_search(corpus, text_plans, candidate_k))
    hits = fuse_and_cut(lists, rescue_tables(corpus, text_plans), top_k)
    few = plans.select("query_id").limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS
    return (F.broadcast(hits) if few else hits).join(chunks, "chunk_id")  # few: no text is shuffled


def embedded(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """Rows with their default embedding."""
    return df.select(key, *keep).join(hashed_tf(df, key, text), key)


def corpus_vectors(chunks: DataFrame) -> DataFrame:
    return embedded(chunks, "chunk_id", "raw_text", list(PARTS))


#: factor of the combined key where each question has companies of its own
STRIDE = 1 << 16


def _companies(plans: DataFrame, tickers: list[str] | str) -> Column:
    """Distinct companies of a question: the same for all, or from its array column. A
    question that names none keeps its own ``ticker``, and is searched once."""
    if not isinstance(tickers, str):
        return F.array(*[F.lit(t) for t in tickers])
    named = F.filter(F.array_distinct(F.transform(tickers, lambda t: F.upper(F.trim(t)))), lambda t: t.isNotNull() & (t != ""))
    own = F.col("ticker") if "ticker" in plans.columns else F.lit(None).cast("string")
    return F.when(F.size(named) >= STRIDE, F.raise_error(F.lit(f"a question names {STRIDE} companies or more"))).when(F.size(named) > 0, named).otherwise(F.array(own))


def expand_entities(plans: DataFrame, tickers: list[str] | str) -> DataFrame:
    """One plan per question and company; ``query_id`` becomes a combined key
    (question x number of tickers + position). ``tickers``: companies for every question, or
    the array column with each question's own; then the factor is ``STRIDE``."""
    n = STRIDE if isinstance(tickers, str) else len(tickers)
    listed = plans.withColumn("_companies", _companies(plans, tickers))
    return listed.select(
        "*", F.posexplode("_companies").alias("pos", "entity")
    ).withColumn("question", F.col("query_id")).withColumn("query_id", F.col("query_id") * n + F.col("pos")).withColumn("ticker", F.col("entity")).drop("_companies")


def hybrid_per_entity(chunks: DataFrame, vectors: DataFrame, plans: DataFrame, tickers: list[str] | str, top_k: int = fixed.HYBRID_TOP_K) -> DataFrame:
    """Hybrid search per company with its share of the result, merged on the
    best score per chunk. ``tickers`` as in ``expand_entities``; the share
    follows the number of companies of the question."""
    own = isinstance(tickers, str)
    share = max(2, top_k if own else top_k // max(1, len(tickers)))
    n = STRIDE if own else len(tickers)
    per = expand_entities(plans, tickers)
    searched = per.drop("pos", "entity", "question", *([tickers] if own else []))
    hits = hybrid_search(chunks, vectors, searched, top_k=share).withColumn("question", F.floor(F.col("query_id") / n).cast("long"))
    if own:  # the search orders all, so that a smaller share is its first rows
        sizes = plans.select(F.col("query_id").alias("question"), F.greatest(F.lit(2), F.floor(top_k / F.size(_companies(plans, tickers)))).alias("share"))
        hits = hits.join(sizes, "question").where("rank <= share")
    best = (
        hits.withColumn("query_id", F.col("question"))
        .groupBy("query_id", "chunk_id")
        .agg(F.max(F.round("rrf_score", 6)).alias("rrf_score"), F.first("ticker").alias("ticker"), F.max("dense_score").alias("dense_score"),
             F.max("sparse_score").alias("sparse_score"), F.max("rescued_table").alias("rescued_table"))
    )
    return rank_top(best, top_k, ["query_id"], score="rrf_score")


def balanced_retrieval(hits: DataFrame, n_tickers: int, per_ticker: int) -> DataFrame:
    """Concatenate per-ticker lists in ticker order, first occurrence of a chunk
    kept. ``hits``: combined query_id (see ``expand_entities``), chunk_id, rank.
    ``n_tickers``: the factor of that key, ``STRIDE`` for companies from a column."""
    h = hits.where(F.col("rank") <= per_ticker).withColumns({
        "question": F.floor(F.col("query_id") / n_tickers).cast("long"), "pos": (F.col("query_id") % n_tickers).cast("int")})
    first = h.groupBy("question", "chunk_id").agg(F.min(F.struct("pos", "rank")).alias("at"))
    w = Window.partitionBy("question").orderBy("at")
    return first.select("question", "chunk_id", F.col("at.pos").alias("ticker_pos"), F.row_number().over(w).alias("position"))
