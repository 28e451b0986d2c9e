"""Replay detection on a stream: keyed state with timers.

Of every (full id, payload) it is kept how often it came within ``keep`` of its last
message; every message after the first is reported with the number so far.  An event-time
timer ends what is kept ``keep`` after the last message or soon after, so that the state stays
bounded on an unbounded stream; messages older than the watermark are late and ignored.

Most keys come once or twice, and each call to the state store costs more than counting
a few messages, so keys with the same hash bucket share one state and one timer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brokerlens.operators.detect import with_full_id

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REPLAY = "general_full_id string, mqtt_message_value string, ts timestamp, count long"
BUCKETS = 1 << 14    # of keys; each has one state
TIMERS = 8           # of a bucket at most while a key is kept


class ReplayCounter(StatefulProcessor):
    """Counts the messages of the keys of a bucket; forgets a key when ``keep_ms`` have gone by since its last message."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms
        self.step = max(1, keep_ms // TIMERS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "ids array<string>, payloads array<string>, counts array<long>, lasts array<long>, timer long")

    def _load(self) -> tuple[dict, int]:
        if not self.kept.exists():
            return {}, 0
        ids, payloads, counts, lasts, timer = self.kept.get()
        return {(i, p): (n, last) for i, p, n, last in zip(ids, payloads, counts, lasts)}, timer

    def _store(self, seen: dict, timer: int) -> None:
        """Keep ``seen``, with a timer at the end of the earliest key, rounded up to a ``step``; ``timer`` is the pending one or 0."""
        if not seen:
            self.kept.clear()
            return
        if not timer:
            end = min(last for _, last in seen.values()) + self.keep_ms
            timer = -(-end // self.step) * self.step
            self.handle.registerTimer(timer)
        ids, payloads = zip(*seen)
        counts, lasts = zip(*seen.values())
        self.kept.update((list(ids), list(payloads), list(counts), list(lasts), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        messages = sorted(m for pdf in rows for m in zip(pdf["at"].tolist(), pdf["general_full_id"].tolist(), pdf["mqtt_message_value"].tolist())
                          if m[0] >= watermark)
        found = []
        if messages:
            seen, timer = self._load()
            for t, full_id, payload in messages:
                n, last = seen.get((full_id, payload), (0, 0))
                n = n + 1 if n and t - last <= self.keep_ms else 1
                seen[full_id, payload] = n, max(last, t)
                if n > 1:
                    found.append((full_id, payload, t, n))
            self._store(seen, timer)
        if found:
            out = pd.DataFrame(found, columns=["general_full_id", "mqtt_message_value", "ts", "count"])
            yield out.assign(ts=pd.to_datetime(out["ts"], unit="ms"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        gone = lambda end: end < watermark or end <= fired
        self._store({k: v for k, v in self._load()[0].items() if not gone(v[1] + self.keep_ms)}, 0)
        yield from ()

    def close(self) -> None:
        pass


def replay_stream(messages: DataFrame, keep_seconds: int = 3600, watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Streaming rows (general_full_id, mqtt_message_value, ts, count): each message that repeats an earlier one of the
    same full id and payload within ``keep_seconds``, and the how-many-th it is."""
    rows = with_full_id(messages).where("general_full_id IS NOT NULL AND mqtt_message_value IS NOT NULL").where(F.col(ts).isNotNull())
    bucket = F.pmod(F.xxhash64("general_full_id", "mqtt_message_value"), F.lit(BUCKETS)).cast("int")
    rows = rows.withWatermark(ts, watermark).select(bucket.alias("bucket"), "general_full_id", "mqtt_message_value", F.col(ts).alias("ts"), F.unix_millis(ts).alias("at"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        ReplayCounter(keep_seconds * 1000), outputStructType=REPLAY, outputMode="Append", timeMode="EventTime")


def replay_alerts(spark: SparkSession, stream: DataFrame, base_dir: str, keep_seconds: int = 3600, watermark: str = "10 minutes",
                  min_count: int = 1) -> DataFrame:
    """Run ``replay_stream`` over everything available now: per (full id, payload) the largest count, above ``min_count``."""
    run = f"{base_dir.rstrip('/')}/replay-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        q = (replay_stream(stream, keep_seconds, watermark).writeStream.outputMode("append").format("parquet")
             .option("path", f"{run}/alerts").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    try:
        found = spark.read.schema(REPLAY).parquet(f"{run}/alerts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], REPLAY)      # no micro-batch has run, so none wrote
    return found.groupBy("general_full_id", "mqtt_message_value").agg(F.max("count").alias("count")).where(F.col("count") > min_count)
