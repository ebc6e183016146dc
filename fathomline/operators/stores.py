"""Chunk and vector tables: keyed lookup, merge, scoped delete.

A store is a DataFrame; ``sources.snapshots`` keeps it as versioned Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def scan_chunks_filtered(chunks: DataFrame, ticker: str | None = None, tickers: list[str] | None = None, fiscal_year: object | None = None,
                         section: str | None = None, limit: int | None = None) -> DataFrame:
    """Exact filters pushed to the scan; empty values do not filter. ``limit``
    (off by default) keeps the first rows by chunk_id."""
    out = chunks
    if tickers and len(tickers) > 1:
        out = out.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
    elif ticker and ticker.strip():
        out = out.where(F.col("ticker") == ticker.strip().upper())
    if fiscal_year not in (None, ""):
        out = out.where(F.col("fiscal_year") == str(fiscal_year).strip())
    if section and section.strip():
        out = out.where(F.col("section") == section.strip())
    return out if limit is None else out.orderBy("chunk_id").limit(limit)


def lookup_by_id(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key is wanted; unknown keys drop out."""
    return chunks.join(ids.select(key).distinct(), key, "left_semi")


def scan_by_source_id(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the wanted filings; rows without identity never match."""
    return chunks.join(sources.select("source_id").where(is_keyed(F.col("source_id"))).distinct(), "source_id", "left_semi")


def is_keyed(source_id: Column) -> Column:
    t = F.trim(source_id)
    return source_id.isNotNull() & (t != "") & (t != fixed.UNKNOWN)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key by ``order``: an aggregation, combined before the
    shuffle, so a key written very often does not gather in one task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by key: incoming values win where present, other fields survive."""
    cols = list(dict.fromkeys([*existing.columns, *incoming.columns]))
    e, n = existing.withColumn("_e", F.lit(True)), incoming.withColumn("_n", F.lit(True))
    e = e.select(*keys, F.struct(*[c for c in existing.columns if c not in keys], "_e").alias("e"))
    n = n.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys], "_n").alias("n"))
    j = e.join(n, keys, "full_outer")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        else:
            sides = [F.col(f"{s}.{c}") for s, df in (("n", incoming), ("e", existing)) if c in df.columns]
            out.append(F.coalesce(*sides).alias(c))
    return j.select(*out, F.col("e._e").isNull().alias("_inserted"), F.col("n._n").isNotNull().alias("_written"))


def delete_stale(existing: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows left after removing (source_id, chunk_id) pairs; a row needs both to
    match, so unkeyed rows are never removed."""
    return existing.join(stale.select("source_id", "chunk_id").distinct(), ["source_id", "chunk_id"], "left_anti")


def store_stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows per ticker in both stores and in total."""
    a = chunks.select("ticker", F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = a.unionByName(vectors.select("ticker", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.rollup("ticker").agg(F.sum("a").alias("chunks"), F.sum("b").alias("vectors"), F.grouping("ticker").alias("g")).select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("ticker")).alias("ticker"), "chunks", "vectors")


def ingestion_metrics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("chunk_type") == "text").alias("text_chunks"),
        F.count_if(F.col("chunk_type") == "table").alias("table_chunks"))
