"""Filing files: ``<TICKER>/<FORM>/<YEAR or ACCESSION>/<file>`` below a root."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws

TEXT_FILES = "*.{txt,html,htm,sgml}"
MIN_CHARS = 200


def scan_filings(spark: SparkSession, root: str, tickers: list[str] | None = None, form: str = "10-K", max_chars: int | None = None) -> DataFrame:
    """Whole filing texts with path metadata; shorter than 200 characters are
    skipped. ``max_chars`` (off by default) cuts each text."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", TEXT_FILES).load(root)
        .select("path", F.col("content").alias("bytes"))
    )
    at = F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$", 1)
    rel = F.regexp_extract("path", r"[^/]+/([^/]+/[^/]+/[^/]+)$", 1)
    docs = raw.select(
        "path", at.alias("ticker"), F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$", 2).alias("form"), rel.alias("source_file"),
        trim_ws(F.expr("string(bytes)")).alias("content"))
    docs = docs.where((F.col("form") == form) & (F.length("content") >= MIN_CHARS))
    if tickers:
        docs = docs.where(F.col("ticker").isin(tickers))
    return docs if max_chars is None else docs.withColumn("content", F.substring("content", 1, max_chars))


def write_filings(files: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below the shared ``root`` (any file
    system Arrow knows), each task its own; a retried task overwrites."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        n = 0
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                target = f"{base}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content.encode("utf-8"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0]
