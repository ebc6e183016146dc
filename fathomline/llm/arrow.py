"""Arrow batches in pieces of bounded bytes, and tables cut out of their lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import shared_folder

BLOCK_BYTES = 1 << 20


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(n)
        yield batch.slice(first)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read it, and a lost
    executor costs no more than what it was reading."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
