"""Streams whose rows come late: totals do not depend on order and batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomline.operators import analytics
from fathomline.session import shared_folder
from fathomline.sources import derived as d
from fathomline.streaming import audit
from tests.conftest import SF

VALID = "CASE WHEN total_latency_ms > 0 AND total_latency_ms <= 600000 THEN total_latency_ms END"
SCHEMA = "request_id long, user_identifier long, time timestamp"


def at(minute, day=1):
    return dt.datetime(2024, 1, day, 10, 0) + dt.timedelta(minutes=minute)


def arriving(spark, batches, schema):
    """A stream that brings one batch after the other."""
    folder = shared_folder(spark, "arriving")
    for i, rows in enumerate(batches):
        df = rows if hasattr(rows, "schema") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def totals(spark, path):
    return sorted(((r.start, r.user_identifier, r.requests, r.violation) for r in audit.rate_totals(spark, path, 2).collect()), key=str)


def test_unordered_batches_give_the_totals_of_one(spark):
    batches = [[(1, 7, at(60)), (2, 7, at(61)), (3, None, at(60))], [(4, 7, at(0)), (5, 7, at(0)), (6, 8, None)], [(7, 7, at(0)), (8, 7, at(60))]]
    parts = audit.run_rate_windows(arriving(spark, batches, SCHEMA))
    whole = audit.run_rate_windows(arriving(spark, [sum(batches, [])], SCHEMA))
    assert totals(spark, parts) == totals(spark, whole)
    rows = {(r.start, r.user_identifier): r for r in audit.rate_totals(spark, parts, 2).collect()}
    corrected = rows[at(0), 7]
    assert (corrected.requests, corrected.late_requests, corrected.violation) == (3, 3, True)
    assert (rows[at(60), 7].requests, rows[at(60), 7].late_requests) == (2, 0)
    # what came behind the watermark or without a time stands in a table of its own
    assert {r.request_id for r in audit.late_rows(spark, parts).collect()} == {4, 5, 6, 7}
    assert {r.request_id for r in audit.late_rows(spark, whole).collect()} == {6}


def test_a_repeated_batch_changes_nothing(spark):
    stream = arriving(spark, [[(1, 7, at(60))], [(2, 7, at(0))]], SCHEMA)
    path, state = shared_folder(spark, "rate"), shared_folder(spark, "state")
    audit.run_rate_windows(stream, path=path, checkpoint=state)
    before = totals(spark, path)
    spark_path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/1")
    spark_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark_path, False)  # as if it stopped before the commit
    audit.run_rate_windows(stream, path=path, checkpoint=state)
    assert totals(spark, path) == before and len(before) == 2


def test_perf_windows_over_batches_equal_the_batch_operator(spark):
    events = d.table(spark, SF, "events")
    e = events.select(*d.audit_columns(F.get_json_object("props", "$.k").cast("int")), F.col("ts").cast("timestamp").alias("time"))
    e = e.where("request_id < 3000").cache()
    batches = [e.where(F.pmod("request_id", F.lit(3)) == i) for i in (2, 0, 1)]
    got = audit.perf_totals(spark, audit.run_perf_windows(arriving(spark, batches, e.schema)))
    want = e.groupBy(F.window("time", "1 day")["start"].alias("start")).agg(*analytics.perf_measures(), F.expr(f"percentile({VALID}, 0.5)").alias("median"))
    assert sorted(want.columns[:8]) == sorted(got.columns[:8])
    both = got.join(want.select("start", "median", *[F.col(c).alias("w_" + c) for c in want.columns[1:8]]), "start", "full").collect()
    assert both
    for r in both:
        for c in want.columns[1:8]:
            assert r[c] == pytest.approx(r["w_" + c], abs=0.1001 if "avg" in c else 1e-9), c
        # a sketch returns a value that stands in the data, next to the interpolated one
        assert (r.median is None) == (r.p50_latency_ms is None)


def test_repeats_are_dropped_however_late(spark):
    schema = "event_id string, time timestamp"
    batches = [[("a", at(0)), ("a", at(0)), (None, at(0)), ("n", None)], [("b", at(0, 20)), ("c", at(0, 20))], [("a", at(0)), ("b", at(1, 20)), ("d", at(0)), (None, at(0)), ("n", None)], []]
    path = audit.run_dedupe(arriving(spark, batches, schema), "event_id")
    kept = [r.event_id for r in spark.read.parquet(path).select("event_id").collect()]
    assert sorted(k for k in kept if k) == ["a", "b", "c", "d", "n"] and kept.count(None) == 2
