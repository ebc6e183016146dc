"""Streaming queries: each runs its job over the whole table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import derived as d
from ..streaming import audit, cache_state, chunks
from . import analytics as an
from . import ingestion as ing
from .registry import query

W = d.sql_with


def stream(spark, sf, name):
    """A driver table, one file or a folder of files, as a file stream. The pattern names
    just the table; a filter on file names would miss the files of a folder."""
    schema = d.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def event_stream(spark, sf):
    return event_rows(stream(spark, sf, "events"))


def event_rows(events):
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(*d.audit_columns(k), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("time"))


ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"


@query("append_audit_events", """SELECT event_id, event_id % 60 <> 1 AS readable, CASE WHEN event_id % 60 <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at_time FROM events""")
def append_audit_events(spark, sf):
    """Batch append with time stamps as text, some of them unreadable."""
    e = d.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 60 == 1, "soon").otherwise(F.expr(ISO)).alias("timestamp"))
    out = e.withColumn("at", audit.parse_timestamp(F.col("timestamp"))).withColumn("readable", F.try_to_timestamp("timestamp").isNotNull())
    return out.select("event_id", "readable", F.when(F.col("readable"), F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("at_time"))


@query("stream_audit_ingest", "SELECT request_id, user_identifier, day FROM (SELECT event_id AS request_id, user_id AS user_identifier, strftime(ts, '%Y-%m-%d') AS day FROM events)")
def stream_audit_ingest(spark, sf):
    e = stream(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("user_identifier"), F.expr(ISO).alias("timestamp"))
    out = spark.read.parquet(audit.ingest_events(e))
    return out.select("request_id", "user_identifier", F.col("day").cast("string").alias("day"))


@query("stream_rate_windows", """SELECT strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id AS user_identifier, count(*) AS requests, count(*) > 10 AS violation FROM events GROUP BY time_bucket(INTERVAL 60 SECOND, ts), user_id""")
def stream_rate_windows(spark, sf):
    out = audit.rate_totals(spark, audit.run_rate_windows(event_stream(spark, sf)))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_identifier", "requests", "violation")


@query("stream_rate_windows_unordered", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS user_identifier, count(*) AS requests, count(*) > 3 AS violation FROM events GROUP BY ALL""")
def stream_rate_windows_unordered(spark, sf):
    """Events in four files dealt by id, a batch each: most windows get rows after they close."""
    path = shared_folder(spark, "unordered")
    e = event_rows(d.table(spark, sf, "events")).repartition(4, F.col("request_id"))
    e.write.parquet(path)
    arriving = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = audit.rate_totals(spark, audit.run_rate_windows(arriving, "1 day"), 3)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_identifier", "requests", "violation")


@query("stream_rate_windows_daily", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS user_identifier, count(*) AS requests, count(*) > 3 AS violation FROM events GROUP BY ALL""")
def stream_rate_windows_daily(spark, sf):
    out = audit.rate_totals(spark, audit.run_rate_windows(event_stream(spark, sf), "1 day"), 3)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_identifier", "requests", "violation")


@query("stream_perf", W(["audit_events"], f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {an.PERF} FROM audit_events GROUP BY date_trunc('day', ts)"))
def stream_perf(spark, sf):
    out = audit.perf_totals(spark, audit.run_perf_windows(event_stream(spark, sf)))
    return out.withColumn("day", F.date_format("start", "yyyy-MM-dd")).drop("start", *an.PCT_COLS)


@query("stream_dedupe_events", "SELECT event_id, user_id FROM events")
def stream_dedupe_events(spark, sf):
    """Every event arrives three times and is kept once."""
    e = stream(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("time"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    return spark.read.parquet(audit.run_dedupe(e, "event_id")).select("event_id", "user_id")


def cache_entries(spark, sf):
    """Events as cache writes: key per user and type, one hour to live."""
    at = F.col("ts").cast("timestamp")
    return stream(spark, sf, "events").select(
        F.concat_ws(":", F.lit("sem_cache"), F.col("user_id").cast("string"), "event_type").alias("cache_key"), at.alias("ts"),
        F.format_string("%010d", "event_id").alias("answer"), (F.unix_millis(at) + 3600 * 1000 * 24 * 5).alias("expires_ms"))


@query("stream_cache_state", """SELECT cache_key, answer FROM (SELECT 'sem_cache:' || user_id || ':' || event_type AS cache_key, arg_max(printf('%010d', event_id), {'a': ts, 'b': event_id}) AS answer, max(ts) AS t FROM events GROUP BY ALL)
    WHERE epoch_ms(t) + 432000000 > (SELECT epoch_ms(max(ts)) FROM events) - 3600000""")
def stream_cache_state(spark, sf):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        path = audit.run(cache_state.cache_changes(cache_entries(spark, sf)), "cache-state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return cache_state.live_entries(spark.read.parquet(path)).select("cache_key", "answer")


@query("stream_chunk_ingest")
def stream_chunk_ingest(spark, sf):
    """Filings arrive as a stream and end in both stores."""
    pages = ing.filing_columns(stream(spark, sf, "pages")).select(F.concat(F.col("page_id").cast("string"), F.lit("/"), "path").alias("path"), "content")
    chunk_store, vector_store = chunks.ingest_stream(pages)
    out = "path string, chunk_id string, chunk_type string, section string, token_count int, dims int"
    if chunk_store.read() is None:  # no page gave a chunk
        return spark.createDataFrame([], out)
    v = vector_store.read().select("path", "chunk_id", F.size("embedding").alias("dims"))
    return chunk_store.read().join(v, ["path", "chunk_id"], "left").select("path", "chunk_id", "chunk_type", "section", "token_count", "dims")
