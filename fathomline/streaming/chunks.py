"""Continuous filing ingestion into the chunk and the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.dense import hashed_tf
from ..session import shared_folder
from ..sources.snapshots import SnapshotStore


def filing_chunks(files: DataFrame) -> DataFrame:
    """(path, content) -> chunk rows: parse, metadata, clean, chunk."""
    p = ingest.extract_metadata(ingest.parse_filings(files))
    p = ingest.clean_financial_text(p, "text_content")
    keep = ["path", "ticker", "fiscal_year", "doc_type", "source_file", "source_id", "tables"]
    return ingest.chunk_corpus(p.select(*keep, F.col("clean_text").alias("text_content")))


def ingest_stream(files: DataFrame, root: str | None = None, buckets: int = 8) -> tuple[SnapshotStore, SnapshotStore]:
    """Upsert the chunks of every micro-batch into both stores. Stores are keyed
    by (path, chunk_id) and bucketed by path: a batch rewrites only the buckets
    of its filings, and a repeated batch changes nothing."""
    spark = files.sparkSession
    root = root or shared_folder(spark, "ingest")
    keys = ["path", "chunk_id"]
    chunks = SnapshotStore(spark, f"{root}/chunks", keys, ["path"], buckets)
    vectors = SnapshotStore(spark, f"{root}/vectors", keys, ["path"], buckets)

    def load(batch: DataFrame, batch_id: int) -> None:
        staged = f"{root}/staged/{batch_id}"
        filing_chunks(batch).write.mode("overwrite").parquet(staged)  # parse once, load twice
        rows = spark.read.parquet(staged)
        if rows.limit(1).count() == 0:
            return
        chunks.upsert(rows)
        v = rows.withColumn("_k", F.concat_ws("#", "path", "chunk_id"))
        v = v.select("path", "chunk_id", "ticker", "fiscal_year", "section", "contains_table", "_k").join(hashed_tf(v, "_k", "raw_text"), "_k").drop("_k")
        vectors.upsert(v)

    q = files.writeStream.foreachBatch(load).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return chunks, vectors
