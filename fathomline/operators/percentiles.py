"""Exact percentiles without gathering a group in one task.

Equal values are counted first, a bounded histogram finds the bucket each
wanted rank falls in, and only those buckets are ordered by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 2048


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None, nearest: bool = False) -> DataFrame:
    """One row per key group and one column per entry of ``probs``.

    Linear interpolation at (n - 1) * p; with ``nearest`` the element at
    floor(n * p) of the sorted values. Nulls are ignored."""
    keys = keys or []
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        span = freq.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        placed = freq.join(span, keys)
    else:
        placed = freq.withColumns({"_lo": freq.agg(F.min("_v")).scalar(), "_hi": freq.agg(F.max("_v")).scalar()})
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    placed = placed.withColumn("_b", F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS)).cast("int"))
    part = keys or [F.lit(1)]
    upto = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    hist = hist.withColumns({"_end": F.sum("_bn").over(upto), "_total": F.sum("_bn").over(Window.partitionBy(*part))})
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    hist = hist.select(*keys, "_b", "_bn", "_end", "_total", wanted.alias("_w"))
    at: Column = (
        F.least(F.floor(F.col("_total") * F.col("_w.p")), F.col("_total") - 1).cast("double") if nearest
        else (F.col("_total") - 1) * F.col("_w.p"))
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    hits = (
        hist.select(*keys, "_b", "_bn", "_end", "_w", at.alias("_at"), F.explode(ranks).alias("_rank"))
        .where((F.col("_rank") >= F.col("_end") - F.col("_bn")) & (F.col("_rank") < F.col("_end")))
    )
    inside = Window.partitionBy(*keys, "_b", "_w", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select(*keys, "_b", "_v", "_n").join(hits, [*keys, "_b"]).withColumn(
        "_to", F.col("_end") - F.col("_bn") + F.sum("_n").over(inside))
    rows = rows.where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
    lo, hi, frac = F.min("_v"), F.max("_v"), F.first(F.col("_at") - F.floor("_at"))
    per = rows.groupBy(*keys, "_w").agg((lo + frac * (hi - lo)).alias("_p"))
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_w.name") == n, F.col("_p"))).alias(n) for n in probs])
