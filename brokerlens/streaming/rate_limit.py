"""Real-time rate limiting with Structured Streaming.

Per (source IP, event-time window) message counts with a watermark: state
for a window is dropped once the watermark passes its end, so state stays
bounded on an unbounded stream; rows older than the watermark are late and
ignored.  Output mode is *update*: an (IP, window) row is emitted when its
count changes, so an alert fires as soon as the limit is crossed instead of
when the window closes.  Each micro-batch's updates are appended to a
table; the current alert list is the largest count per (IP, window), an
idempotent reduction, so a micro-batch replayed after a failure changes
nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from brokerlens.operators.detect import RATE_LIMIT_PER_MINUTE


def rate_limit_stream(messages: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE, window: str = "1 minute",
                      watermark: str = "10 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Streaming (or batch) rows (general_ip, window_start, window_end,
    messages) for windows above ``limit``.  ``ts`` must be a TIMESTAMP
    (not TIMESTAMP_NTZ) for the watermark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (messages.where(F.col("general_ip").isNotNull() & F.col(ts).isNotNull())
                    .withWatermark(ts, watermark)
                    .groupBy(w.alias("w"), "general_ip").agg(F.count(F.lit(1)).alias("messages"))
                    .where(F.col("messages") > limit)
                    .select("general_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                            "messages"))


def deduplicate_stream(messages: DataFrame, keys=("general_full_id", "mqtt_message_value"),
                       watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Drop repeated messages (replays) seen within the watermark delay."""
    return messages.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def run_rate_limit(alerts: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True,
                   processing_time: str | None = None):
    """Start the alert stream; each micro-batch's updates are appended
    (with their batch id) under ``sink_dir``."""
    def write_batch(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_dir)

    w = alerts.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(write_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def read_alerts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Current alerts: the largest count seen per (IP, window)."""
    return (spark.read.parquet(sink_dir).groupBy("general_ip", "window_start", "window_end")
                 .agg(F.max("messages").alias("messages")))


def rate_limit_alerts(spark: SparkSession, stream: DataFrame, base_dir: str, limit: int, window: str,
                      watermark: str = "1 hour") -> DataFrame:
    """Run ``rate_limit_stream`` over everything available now and return
    the alert table.  ``base_dir`` is a shared folder (the session's
    ``spark.checkpoint.dir`` in the callers); each run gets a fresh
    sub-folder."""
    run = f"{base_dir.rstrip('/')}/rate-limit-{uuid.uuid4().hex}"
    q = run_rate_limit(rate_limit_stream(stream, limit, window, watermark), f"{run}/alerts", f"{run}/checkpoint")
    q.awaitTermination()
    try:
        return read_alerts(spark, f"{run}/alerts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # no micro-batch has run, so none wrote: empty result with the schema
        return spark.createDataFrame([], "general_ip string, window_start timestamp, window_end timestamp, messages bigint")
