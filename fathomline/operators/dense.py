"""Vector operators: embedding and exact top-k by cosine.

The scan side never moves: each task scores its Arrow batches against the
question block with one matrix product per scope and keeps a running top k per
question, so only k rows per question and task are shuffled. Question blocks
are broadcast while a counted size allows; beyond that both sides meet on a
grid of bounded cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import CANDIDATE_K
from ..functions.text import tokens
from .scopes import PARTS, normalize_filter
from .sparse import best_of, rank_top, token_slices

HASH_DIM = 64
BROADCAST_QUESTIONS = 4096
CELL_QUESTIONS = 4096

HITS = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType()),
])


def hashed_tf(df: DataFrame, key: str, text: str, dim: int = HASH_DIM) -> DataFrame:
    """Default embedder: term counts hashed into ``dim`` buckets, unit length.
    A row's terms are counted where it is; one row of counts per text is shuffled, to add up texts of one key."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sizes in token_slices(batches, "t"):
            words = b.column("t").flatten().dictionary_encode()
            bucket = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:3], "big") % dim for w in words.dictionary.to_pylist()], dtype="int64")
            at = np.repeat(np.arange(b.num_rows), sizes) * dim + bucket[words.indices.to_numpy(zero_copy_only=False)]
            n = np.bincount(at, minlength=b.num_rows * dim).astype("int32")
            ends = pa.array(np.arange(b.num_rows + 1, dtype="int32") * dim)
            out = pa.RecordBatch.from_arrays([b.column("k"), pa.ListArray.from_arrays(ends, pa.array(n))], ["k", "n"])
            yield out.filter(pa.array(sizes > 0))

    counts = df.select(F.col(key).alias("k"), tokens(F.col(text)).alias("t")).mapInArrow(count, f"k {dict(df.dtypes)[key]}, n array<int>")
    per = counts.groupBy("k").agg(F.collect_list("n").alias("n"))
    whole = F.when(F.size("n") == 1, F.get("n", F.lit(0)).cast("array<double>")).otherwise(
        F.aggregate("n", F.array_repeat(F.lit(0.0), dim), lambda a, x: F.zip_with(a, x, lambda u, v: u + v)))
    per = per.select("k", whole.alias("n")).withColumn("norm", F.sqrt(F.aggregate("n", F.lit(0.0), lambda a, x: a + x * x)))
    return per.select(F.col("k").alias(key), F.transform("n", lambda x: x / F.col("norm")).alias("embedding"))


def embed_batch(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Plug-in embedder: ``embed`` gets a list of texts per Arrow batch. A batch
    whose result has the wrong length yields null vectors (dense side off)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                vecs = embed(texts.fillna("").tolist())
            except Exception:  # a failing model switches the dense side off
                vecs = []
            if len(vecs) != len(texts):
                yield pd.Series([None] * len(texts))
                continue
            units = []
            for v in vecs:
                a = np.asarray(v, dtype="float64")
                n = float(np.sqrt((a * a).sum()))
                units.append((a / n if n else a).astype("float32"))
            yield pd.Series(units)

    return df.withColumn(out, run(F.col(text)))


def upsert_defaults(df: DataFrame) -> DataFrame:
    """Payload defaults of a vector row."""
    return df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in ("ticker", "fiscal_year", "doc_type") if c in df.columns},
        **({"section": F.coalesce(F.col("section"), F.lit("General"))} if "section" in df.columns else {}),
        **({"contains_table": F.coalesce(F.col("contains_table"), F.lit(False))} if "contains_table" in df.columns else {}),
    })


def _score(q: dict, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of one batch: a matrix product per distinct filter."""
    if vectors.empty:
        return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
    mat = np.stack([np.asarray(v, dtype="float64") for v in vectors["embedding"]])
    norm = np.sqrt((mat * mat).sum(axis=1))
    norm[norm == 0] = 1.0
    mat = mat / norm[:, None]
    ids = vectors["chunk_id"].to_numpy()
    parts = []
    for flt, rows in q["groups"].items():
        mask = np.ones(len(ids), dtype=bool)
        for col, want in zip(PARTS, flt):
            if want is not None:
                mask &= (vectors[col] == want).to_numpy()
        pos = np.flatnonzero(mask)
        if not len(pos):
            continue
        sims = q["mat"][rows] @ mat[pos].T
        for i, r in enumerate(rows):
            s = sims[i]
            # keep every tie of the k-th best so that chunk_id decides
            keep = np.arange(len(pos)) if len(pos) <= k else np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9)
            parts.append(pd.DataFrame({"query_id": q["ids"][r], "chunk_id": ids[pos[keep]], "score": s[keep]}))
    if not parts:
        return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
    return best_of(pd.concat(parts, ignore_index=True), k)


def _block(rows: pd.DataFrame) -> dict:
    groups: dict[tuple, list[int]] = {}
    for i, flt in enumerate(zip(*[rows[c] for c in PARTS])):
        groups.setdefault(tuple(None if x is None or x != x else x for x in flt), []).append(i)
    mat = np.stack([np.asarray(v, dtype="float64") for v in rows["embedding"]])
    norm = np.sqrt((mat * mat).sum(axis=1))
    norm[norm == 0] = 1.0
    return {"ids": rows["query_id"].to_numpy(), "mat": mat / norm[:, None], "groups": groups}


def knn_hits(vectors: DataFrame, plans: DataFrame, k: int = CANDIDATE_K, broadcast_limit: int = BROADCAST_QUESTIONS) -> DataFrame:
    """Exact top k by cosine: (query_id, chunk_id, score, rank).

    ``vectors``: chunk_id, embedding and the filter columns; ``plans``:
    query_id, embedding and optional filter columns (``tickers`` lists are
    scored per ticker)."""
    p = plans
    for c in PARTS:
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("string"))
        if c not in vectors.columns:
            vectors = vectors.withColumn(c, F.lit(None).cast("string"))
    p = normalize_filter(p)
    if "tickers" in p.columns:
        p = p.withColumn("ticker", F.explode(F.coalesce("tickers", F.array("ticker"))))
    p = p.select("query_id", *PARTS, "embedding").where(F.col("embedding").isNotNull())
    v = vectors.select("chunk_id", *PARTS, "embedding").where(F.col("embedding").isNotNull())

    rows = p.limit(broadcast_limit + 1).toPandas()  # bounded by the limit; decides the way below
    if len(rows) <= broadcast_limit:
        if rows.empty:
            return rank_top(v.sparkSession.createDataFrame([], HITS), k, ["query_id"])
        block = v.sparkSession.sparkContext.broadcast(_block(rows))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for b in batches:
                part = _score(block.value, b, k)
                best = part if best is None else best_of(pd.concat([best, part], ignore_index=True), k)
            if best is not None and len(best):
                yield best

        return rank_top(v.mapInPandas(scan, HITS), k, ["query_id"])
    return rank_top(_grid_hits(v, p, k), k, ["query_id"])


def _grid_hits(v: DataFrame, p: DataFrame, k: int, cell_vectors: int = 200_000) -> DataFrame:
    """Many questions: cells (question block x vector block), each of bounded
    size; a cell returns at most k rows per question."""
    n_q, n_v = p.count(), v.count()
    qb, vb = max(1, -(-n_q // CELL_QUESTIONS)), max(1, -(-n_v // cell_vectors))
    cell = lambda own, other, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other)
    left = v.withColumn("vblock", F.pmod(F.xxhash64("chunk_id"), F.lit(vb)).cast("int")).select("*", cell("vblock", "qblock", qb))
    # names of its own: both sides may come from one table
    named = p.select(F.col("query_id").alias("q_query_id"), *[F.col(c).alias(f"q_{c}") for c in (*PARTS, "embedding")])
    right = named.withColumn("q_block", F.pmod(F.xxhash64("q_query_id"), F.lit(qb)).cast("int")).select("*", cell("q_block", "q_vblock", vb))

    def meet(vectors: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if questions.empty or vectors.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        return _score(_block(questions.rename(columns=lambda c: c.removeprefix("q_"))), vectors, k)

    return left.groupBy("qblock", "vblock").cogroup(right.groupBy("q_block", "q_vblock")).applyInPandas(meet, HITS)


def max_per_chunk(hits: DataFrame, plan: str = "plan_id", k: int = CANDIDATE_K) -> DataFrame:
    """Several queries per plan: best score per chunk, then a global top k."""
    best = hits.groupBy(plan, "chunk_id").agg(F.max("score").alias("score"))
    return rank_top(best, k, [plan])
