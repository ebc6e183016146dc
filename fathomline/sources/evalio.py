"""Evaluation files: CSV datasets and traces, JSON score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import QUALITY_GATES, TRACE_COLUMNS
from ..session import shared_folder

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, purpose: str, path: str | None = None) -> str:
    path = path or shared_folder(df.sparkSession, purpose)
    df.write.options(**{k: v for k, v in CSV.items() if k != "multiLine"}).mode("overwrite").csv(path)
    return path


def read_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Question set; both columns must exist, rows missing either are dropped."""
    df = spark.read.options(**CSV).csv(path)
    missing = [c for c in ("question", "ground_truth") if c not in df.columns]
    if missing:
        raise ValueError(f"dataset lacks columns {missing}; it has {df.columns}")
    return df.dropna(subset=["question", "ground_truth"])


def write_eval_trace(df: DataFrame, path: str | None = None) -> str:
    return write_csv(df.select(*TRACE_COLUMNS), "eval-trace", path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV).schema(", ".join(f"{c} string" for c in TRACE_COLUMNS)).csv(path)


def write_json_lines(df: DataFrame, purpose: str) -> str:
    path = shared_folder(df.sparkSession, purpose)
    df.write.mode("overwrite").text(path)
    return path


_METRICS = ", ".join(f"{m} double" for m in QUALITY_GATES)
SCORES_SCHEMA = f"aggregate_scores struct<{_METRICS.replace(' double', ': double')}>, {_METRICS}, sample_count bigint, samples array<string>, judge_model string"


def read_eval_scores(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per score file: nested aggregates win over root values; the
    sample count falls back to the number of samples."""
    raw = spark.read.schema(SCORES_SCHEMA).option("multiLine", multi_line).json(path)
    nested = F.col("aggregate_scores").isNotNull()
    metrics = [F.coalesce(F.when(nested, F.col(f"aggregate_scores.{m}")).otherwise(F.col(m)), F.lit(0.0)).alias(m) for m in QUALITY_GATES]
    count = F.coalesce("sample_count", F.when(F.col("samples").isNotNull(), F.size("samples")), F.lit(0))
    return raw.select(*metrics, count.alias("sample_count"), F.coalesce("judge_model", F.lit("unknown")).alias("judge_model"))
