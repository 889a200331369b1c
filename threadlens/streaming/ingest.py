"""Export files as they arrive.

The file source hands each new file over once.  A micro-batch is parsed with
the same expressions as a batch read and lands in its own folder, named after
the batch, so a batch that is run again replaces itself.  Identity and merge
stay batch work over the folder: labels are global and may change with any new
file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clock
from ..sources import json_export
from ..sources.catalog import ROW_MASK


def ingest_json(
    spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append the raw messages of new JSON exports below ``source`` to ``target``."""
    stream = (
        spark.readStream.format("text")
        .option("lineSep", json_export.SEPARATOR)
        .load(source)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_id"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))
        fragments = batch.select("file_id", (F.col("block") + row).alias("pos"), "value")
        head = json_export.headers(fragments)
        raw = json_export.scan(fragments).join(
            head.where(~F.col("invalid")).select("file_id", "channel_id", "exported_at"), "file_id"
        )
        raw.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """Everything ingested so far; the file source hands each path over once."""
    return spark.read.parquet(target).drop("batch")


def stream_daily_counts(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Timeline of a message stream: daily counts per channel with a watermark."""
    return (
        messages.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "channel_id")
        .agg(F.count("*").alias("n"))
        .select("channel_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
    )


def stream_sessions(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Sessions of a message stream, as the batch rule has them: per channel and UTC day, a gap above the break's length ends one."""
    gap = f"{clock.SESSION_BREAK_MS + 1} milliseconds"  # a gap of just that length is no break
    return (
        messages.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("s"), "channel_id", clock.day_key(F.col("ts")).alias("day"))
        .agg(F.count("*").alias("n"))
        .select("channel_id", "day", F.col("s.start").alias("started"), "n")
    )


def append_results(results: DataFrame, target: str, checkpoint: str) -> None:
    """Add what a stream's results have final so far to ``target``; the checkpoint keeps the rest for the next call.

    The file sink writes a batch once, whatever is run again.
    """
    (
        results.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def close_stream(messages: DataFrame, source: str, lateness_days: int = 1) -> None:
    """Append one row far behind the last message to ``source``, which makes all open windows final."""
    row = messages.agg(F.max("ts").alias("last")).select(
        *(
            (F.col("last") + F.expr(f"INTERVAL {lateness_days + 2} DAYS")).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in messages.schema.fields
        )
    )
    row.write.mode("append").parquet(source)


def stream_first_copies(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """First copy per message id, for inputs that share one export format."""
    return messages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(
        ["channel_id", "message_id"]
    )
