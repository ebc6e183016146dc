"""The audit feed as Structured Streaming jobs.

Each job reads a file source (or any stream with the same columns), keeps its
state under a watermark and writes Parquet. Windowed results go out in update
mode, one row per changed window and batch; readers take the newest row per
window, so open windows are visible and nothing is recomputed in full.

A stateful aggregation drops rows behind its watermark. ``run_windows`` drops none: each
batch writes mergeable parts of its windows, also of closed ones, and readers add them up.
Its totals are the same in whatever order and batches the rows come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..operators.analytics import perf_from_parts, perf_measures, perf_parts, valid_latency
from ..operators.stores import latest
from ..session import shared_folder


def run(stream: DataFrame, purpose: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None, partition_by: list[str] | None = None) -> str:
    """Run a stream over what is available and return its output folder."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, purpose)
    checkpoint = checkpoint or shared_folder(spark, purpose + "-state")
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").outputMode("append").option("path", path)
        w = w.partitionBy(*partition_by) if partition_by else w
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            # a repeated batch overwrites its own folder: exactly once
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

        w = w.outputMode(mode).foreachBatch(keep)
    q = w.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return path


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path).drop("b"), keys, "_batch").drop("_batch")


def parse_timestamp(raw: Column) -> Column:
    """ISO time as UTC timestamp; what cannot be read is stamped now."""
    return F.coalesce(F.try_to_timestamp(raw), F.current_timestamp())


def ingest_events(events: DataFrame, path: str | None = None) -> str:
    """Continuous append of audit events, partitioned by day."""
    e = events.withColumn("timestamp", parse_timestamp(F.col("timestamp"))).withColumn("day", F.to_date("timestamp"))
    return run(e, "audit", path=path, partition_by=["day"])


def rate_windows(events: DataFrame, window: str = fixed.RATE_WINDOW, limit: int = fixed.RATE_LIMIT, late: str = "10 minutes") -> DataFrame:
    """Requests per user and fixed window; more than the limit is a violation.
    ``events`` needs a timestamp column ``time``."""
    w = events.withWatermark("time", late).groupBy(F.window("time", window), "user_identifier").agg(F.count(F.lit(1)).alias("requests"))
    return w.select(F.col("window.start").alias("start"), "user_identifier", "requests", (F.col("requests") > limit).alias("violation"))


def perf_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The dashboard metrics per window; percentiles are sketches here, the
    exact ones are the batch operator's."""
    pct = F.percentile_approx(valid_latency(F.col("total_latency_ms")), [0.5, 0.95, 0.99], 10000)
    w = events.withWatermark("time", late).groupBy(F.window("time", window)).agg(*perf_measures(), pct.alias("p"))
    return w.select(F.col("window.start").alias("start"), *[c for c in w.columns if c not in ("window", "p")],
                    *[F.get("p", i).alias(n) for i, n in enumerate(("p50_latency_ms", "p95_latency_ms", "p99_latency_ms"))])


def dedupe(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each event once, repeats within the watermark dropped."""
    return events.withWatermark("time", late).dropDuplicatesWithinWatermark([key])


def run_windows(events: DataFrame, purpose: str, window: str, keys: list[str], parts: list[Column], late: str = "10 minutes", path: str | None = None, checkpoint: str | None = None) -> str:
    """Windowed parts of a stream, exactly once: a repeated batch overwrites its own folders.
    Below the returned folder (it and the checkpoint belong together):

    * ``windows``: the parts of each batch by start and ``keys``; ``late`` tells those that
      correct a window which had closed, that is, ended before the watermark;
    * ``late``: the rows behind them as they came, and rows without a time, which no window counts;
    * ``marks``: the newest time up to each batch; the watermark lies ``late`` before it."""
    spark = events.sparkSession
    path = path or shared_folder(spark, purpose)
    checkpoint = checkpoint or shared_folder(spark, purpose + "-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{path}/marks/b={batch_id - 1}").first()["newest"] if batch_id else None
        closed = F.lit(False) if before is None else F.col("_w.end") <= F.lit(before) - F.expr(f"INTERVAL {late}")
        batch = batch.persist()
        try:
            placed = batch.where("time IS NOT NULL").withColumn("_w", F.window("time", window)).withColumn("late", closed)
            placed.groupBy(F.col("_w.start").alias("start"), *keys, "late").agg(*parts).write.mode("overwrite").parquet(f"{path}/windows/b={batch_id}")
            behind = placed.where("late").drop("_w", "late").unionByName(batch.where("time IS NULL"))
            behind.write.mode("overwrite").parquet(f"{path}/late/b={batch_id}")
            newest = F.greatest(F.max("time"), F.lit(before).cast("timestamp")).alias("newest")
            batch.agg(newest).write.mode("overwrite").parquet(f"{path}/marks/b={batch_id}")
        finally:
            batch.unpersist()

    q = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return path


def window_totals(spark: SparkSession, path: str, keys: list[str], merged: list[Column]) -> DataFrame:
    """Parts of all batches added up, one row per start and ``keys``."""
    return spark.read.parquet(f"{path}/windows").groupBy("start", *keys).agg(*merged)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("b")


def rate_totals(spark: SparkSession, path: str, limit: int = fixed.RATE_LIMIT) -> DataFrame:
    """Requests per user and window, the late ones of them, and whether they exceed the limit."""
    late = F.coalesce(F.sum(F.when(F.col("late"), F.col("requests"))), F.lit(0)).alias("late_requests")
    return window_totals(spark, path, ["user_identifier"], [F.sum("requests").alias("requests"), late]).withColumn("violation", F.col("requests") > limit)


def run_rate_windows(events: DataFrame, window: str = fixed.RATE_WINDOW, late: str = "10 minutes", **folders: str) -> str:
    return run_windows(events, "rate", window, ["user_identifier"], [F.count(F.lit(1)).alias("requests")], late, **folders)


def run_perf_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour", **folders: str) -> str:
    return run_windows(events, "perf", window, [], perf_parts(), late, **folders)


def perf_totals(spark: SparkSession, path: str) -> DataFrame:
    """The dashboard metrics per window; percentiles are sketches, as in ``perf_windows``."""
    return perf_from_parts(spark.read.parquet(f"{path}/windows"), ["start"])


def run_dedupe(events: DataFrame, key: str, path: str | None = None, checkpoint: str | None = None) -> str:
    """Each event once, however late its repeats come. A repeat carries the time of its event
    give or take a day, so a batch meets only the stored days next to its own. Rows
    without a key repeat nothing and stay; rows without a time are a day of their own."""
    spark = events.sparkSession
    path = path or shared_folder(spark, "dedupe")
    checkpoint = checkpoint or shared_folder(spark, "dedupe-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", F.coalesce(F.to_date("time").cast("string"), F.lit("none"))).persist()
        try:
            keyed = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
            if batch_id:
                at = F.to_date(F.nullif(F.col("day"), F.lit("none")))
                near = rows.select(F.explode(F.array(F.col("day"), F.date_sub(at, 1).cast("string"), F.date_add(at, 1).cast("string"))).alias("day")).distinct()
                stored = spark.read.schema(rows.schema).option("basePath", path).parquet(*[f"{path}/b={b}" for b in range(batch_id)])
                days = [r["day"] for r in near.where("day IS NOT NULL").collect()]  # days of one batch
                keyed = keyed.join(stored.where(F.col("day").isin(days)).select(key), key, "left_anti").select(*rows.columns)
            keyed.unionByName(rows.where(F.col(key).isNull())).write.mode("overwrite").partitionBy("day").parquet(f"{path}/b={batch_id}")
        finally:
            rows.unpersist()

    q = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return path
