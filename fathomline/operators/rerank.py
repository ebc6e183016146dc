"""After retrieval: pair scoring, top n, rescue, table shield, reading order.

Everything works on (query_id, chunk) rows of at most a few dozen per question,
so the windows are small whatever the number of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.text import find_all, tokens


def score_overlap(pairs: DataFrame, query: str = "query", text: str = "raw_text") -> DataFrame:
    """Default scorer: share of the question's distinct tokens in the text."""
    q = F.array_distinct(tokens(F.col(query)))
    hit = F.size(F.array_intersect(q, tokens(F.col(text))))
    return pairs.withColumn("rerank_score", F.when(F.size(q) == 0, 0.0).otherwise(hit / F.size(q)))


def score_pairs(pairs: DataFrame, query: str, text: str, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Plug-in scorer over Arrow batches; a failing batch scores zero."""
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            try:
                scores = [float(s) for s in scorer(q.fillna("").tolist(), t.fillna("").tolist())]
            except Exception:
                scores = []
            yield pd.Series(scores if len(scores) == len(q) else [0.0] * len(q))

    return pairs.withColumn("rerank_score", run(F.col(query), F.col(text)))


def _by_score() -> Window:
    return Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), F.col("rank"))


def rerank_topn(scored: DataFrame, n: int = fixed.RERANK_TOP_N) -> DataFrame:
    """Best n per question; equal scores keep the retrieval order."""
    return scored.withColumn("position", F.row_number().over(_by_score())).where(F.col("position") <= max(1, n))


def promote_rescued(scored: DataFrame, n: int = fixed.RERANK_TOP_N) -> DataFrame:
    """Top n, with rescued tables that missed it put in front."""
    r = scored.withColumn("_r", F.row_number().over(_by_score())).where((F.col("_r") <= n) | F.col("rescued_table"))
    kept = F.col("_r") <= n
    w = Window.partitionBy("query_id").orderBy(kept, F.when(kept, F.col("_r")).otherwise(F.col("rank")))
    return r.withColumn("position", F.row_number().over(w)).drop("_r")


def shield_tables(chunks: DataFrame, text: str = "raw_text") -> DataFrame:
    """``cleaned_text``: tables as they are; other text without links and filler
    phrases, unless that would lose a figure, date or currency sign."""
    t = F.regexp_replace(text, r"https?://[^\s]+|[\w.+-]+@[\w-]+\.[\w.]+", " ")
    t = F.regexp_replace(t, r"(?i)\b(" + "|".join(fixed.FILLER_PHRASES) + r")\b,?", " ")
    cleaned = F.trim(F.regexp_replace(t, r"\s+", " "))
    must = F.array_distinct(find_all(F.col(text), fixed.PRESERVE_PATTERN))
    kept = F.forall(must, lambda m: F.contains(F.col("_clean"), m))
    return (
        chunks.withColumn("_clean", cleaned)
        .withColumn("cleaned_text", F.when(F.col("contains_table") | ~kept, F.col(text)).otherwise(F.col("_clean")))
        .drop("_clean")
    )


def cylinder_order(ranked: DataFrame, pattern: list[int] | None = None) -> DataFrame:
    """``place``: best first, second best last, the rest alternating inwards.
    A custom ``pattern`` lists the rank (from 0) at each place."""
    r = F.col("position") - 1
    if pattern is not None:
        if sorted(pattern) != list(range(len(pattern))):
            raise ValueError("pattern must be a permutation")
        place = F.array_position(F.array(*[F.lit(p) for p in pattern]), r.cast("int")) - 1
    else:
        n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        place = F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2))
    return ranked.withColumn("place", place.cast("int"))


def post_retrieval(scored: DataFrame, n: int = fixed.RERANK_TOP_N) -> DataFrame:
    """Top n, rescued tables, shield, reading order."""
    return cylinder_order(shield_tables(promote_rescued(scored, n)))
