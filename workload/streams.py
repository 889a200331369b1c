"""Streams over the given tables, held against the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadlens.functions import clock
from threadlens.session import work_dir
from threadlens.streaming import ingest

from .tables import CHATS, EVENTS, chat_messages, event_messages, with_sql

QUERIES = {}
SQL = {}


def query(name, sql, ctes):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = with_sql(*ctes, body=sql)
        return fn

    return add


def in_waves(spark, waves, apply, closing=True):
    """``apply`` to a stream that gets ``waves`` one after another; what it has emitted when the stream is closed."""
    base = f"{work_dir(spark)}/threadlens/stream-{uuid.uuid4().hex}"
    source = f"{base}/in"
    results = None
    for wave in waves:
        wave.write.mode("append").parquet(source)
        results = apply(spark.readStream.schema(wave.schema).parquet(source))
        ingest.append_results(results, f"{base}/out", f"{base}/state")
    if closing:
        ingest.close_stream(spark.read.parquet(source), source)
        ingest.append_results(results, f"{base}/out", f"{base}/state")
    return spark.read.schema(results.schema).parquet(f"{base}/out").where("channel_id IS NOT NULL")


def event_waves(spark, sf_dir):
    """The older half and then the newer half; a few of the older rows come late, with the newer ones."""
    m = event_messages(spark, sf_dir).select("channel_id", "message_id", "ts")
    bounds = m.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half = bounds["a"] + (bounds["b"] - bounds["a"]) / 2
    newer = F.col("ts") >= F.lit(half)
    late = (F.col("ts") >= F.lit(half) - F.expr("INTERVAL 6 HOURS")) & (F.xxhash64("message_id") % 4 == 0)
    return m.where(~newer & ~late), m.where(newer | late)


@query("stream_timeline", "SELECT channel_id, day, count(*) AS n FROM enr GROUP BY ALL", EVENTS)
def stream_timeline(spark, sf_dir):
    return in_waves(spark, event_waves(spark, sf_dir), ingest.stream_daily_counts)


@query("stream_sessions", """
SELECT channel_id, day, epoch_us(min(ts)) // 1000 AS started_ms, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN t - prev > 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS session FROM (
    SELECT *, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS prev FROM enr))
GROUP BY channel_id, day, session""", EVENTS)
def stream_sessions(spark, sf_dir):
    found = in_waves(spark, event_waves(spark, sf_dir), ingest.stream_sessions)
    return found.select("channel_id", "day", clock.millis(F.col("started")).alias("started_ms"), "n")


@query("stream_first_copies", "SELECT channel_id, message_id, is_system FROM cmsgs", CHATS)
def stream_first_copies(spark, sf_dir):
    """Every message comes twice, every third a third time in a later wave."""
    m = chat_messages(spark, sf_dir).select("channel_id", "message_id", "ts", "is_system")
    again = m.where(F.xxhash64("message_id") % 3 == 0)
    found = in_waves(spark, (m.unionByName(m), again), lambda s: ingest.stream_first_copies(s, "3650 days"), closing=False)
    return found.select("channel_id", "message_id", "is_system")
