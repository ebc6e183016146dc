"""The answer cache as streaming state: last answer per key, with expiry.

Keys share the state of a bucket, which is read, changed and written as one table: a call
into Python for each key, with the state store's answers in between, took most of the time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "rows binary"
OUT = "cache_key string, ts timestamp, answer string, expires_ms bigint, event string"
FIELDS = ["cache_key", "ts", "answer", "expires_ms"]
#: more of them keep a bucket small when there are very many live keys; fixed for a checkpoint
BUCKETS = 1024


def newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The last row per key by time and answer; of equal ones the last in the table."""
    return rows.sort_values(["ts", "answer"], kind="stable", na_position="first").drop_duplicates("cache_key", keep="last")


class AnswerState(StatefulProcessor):
    """Keeps the newest answer of each key of a bucket; an event-time timer drops those
    whose time to live is over and reports that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("answers", STATE)

    def _held(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(bytes(self.value.get()[0])).read_pandas() if self.value.exists() else None

    def _keep(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.value.clear()
            return
        table = pa.Table.from_pandas(rows[FIELDS], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.value.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(rows["expires_ms"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        put = None
        for pdf in rows:
            top = newest(pdf[FIELDS])
            put = top if put is None else newest(pd.concat([put, top]))
        if put is None or not len(put):
            return
        held = self._held()
        now = put.assign(new=True)
        if held is not None:  # behind the new ones, so that it stays where both are equal
            now = newest(pd.concat([now, held.assign(new=False)]))
        changed = now[now["new"].astype(bool)]
        if len(changed):
            self._keep(now)
            yield changed[FIELDS].assign(event="put")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is None:
            return
        over = held["expires_ms"] <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if over.any():
            self._keep(held[~over])
            yield held[over][FIELDS].assign(event="expired")
        else:  # the timer of a row that a newer one has replaced
            self.handle.registerTimer(int(held["expires_ms"].min()))

    def close(self) -> None:
        pass


def cache_changes(entries: DataFrame, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Stream of puts and expiries. ``entries``: cache_key, ts, answer, expires_ms."""
    e = entries.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("int"))
    return e.groupBy("bucket").transformWithStateInPandas(AnswerState(), OUT, "Append", "EventTime")


def live_entries(changes: DataFrame) -> DataFrame:
    """Newest put per key that no expiry of the same entry follows."""
    last = changes.groupBy("cache_key").agg(
        F.max_by(F.struct("ts", "answer", "expires_ms"), F.when(F.col("event") == "put", F.struct("ts", "answer"))).alias("p"),
        F.max(F.when(F.col("event") == "expired", F.struct("ts", "answer"))).alias("x"))
    gone = F.coalesce((F.col("x.ts") == F.col("p.ts")) & (F.col("x.answer") == F.col("p.answer")), F.lit(False))
    return last.where(~gone).select("cache_key", "p.*")
