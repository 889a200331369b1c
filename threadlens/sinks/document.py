"""Ordered documents as DataFrames.

A document is a set of rows ``channel_id, sect, k1, k2, k3, text``.  Rows in
the order of these columns, joined by line breaks, are the document.  Nothing
is ever concatenated on the driver or in one task: writing range-partitions the
rows, so one large channel becomes several consecutive part files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ("channel_id", "sect", "k1", "k2", "k3", "text")
ORDER = ("channel_id", "sect", "k1", "k2", "k3")
HEAD, LEGEND, BODY, FOOT = 0, 1, 2, 3


@dataclass(frozen=True)
class RenderOptions:
    max_tokens: int = 1_375_000
    preamble: str = ""
    redact_names: bool = False
    redact_urls: bool = False
    redact_emails: bool = False

    @property
    def limit_text(self) -> str:
        return f"{self.max_tokens:,}"


def row(sect: int, text: Column, k1=None, k2=None, k3=None) -> list[Column]:
    """Select list of one document row."""
    zero = F.lit(0).cast("bigint")
    keys = [zero if k is None else k.cast("bigint") for k in (k1, k2, k3)]
    return [
        F.col("channel_id"),
        F.lit(sect).alias("sect"),
        keys[0].alias("k1"),
        keys[1].alias("k2"),
        keys[2].alias("k3"),
        text.alias("text"),
    ]


def body_row(text: Column) -> list[Column]:
    return row(BODY, text, F.unix_micros("ts"), F.col("file_idx"), F.col("msg_idx"))


def legend(msgs: DataFrame, people: DataFrame) -> DataFrame:
    """Participants per channel: uid, label, count, share and display order.

    Counts are small rows; the label comes from the identity table.
    """
    return legend_of(msgs.groupBy("channel_id", F.col("author_id").alias("uid")).agg(F.count("*").alias("n")), people)


def legend_of(counts: DataFrame, people: DataFrame) -> DataFrame:
    """The same from the counts, ``channel_id, uid, n``."""
    totals = counts.groupBy("channel_id").agg(F.sum("n").alias("total"), F.count("*").alias("users"))
    tenths = F.floor((F.col("n") * 2000 + F.col("total")) / (F.col("total") * 2))
    pct = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("int").cast("string")
    )
    number = F.when(F.col("uid").rlike(r"^U\d{1,18}$"), F.substring("uid", 2, 18).try_cast("bigint"))
    return (
        counts.join(totals, "channel_id")
        .join(people.select("uid", "label"), "uid", "left")
        .withColumn("label", F.coalesce("label", "uid"))
        .withColumn("pct", pct)
        .withColumn("by_number", number)
    )


def number_then_count() -> list[Column]:
    """Order keys of the text legends: ``U<n>`` by number, others by count."""
    return [
        F.coalesce("by_number", F.lit(1 << 40) - F.col("n")),
        F.lit(0),
    ]


def channel_starts(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("channel_id").agg(F.min("ts").alias("start"), F.count("*").alias("total"))


def empty_documents(msgs: DataFrame, channels: DataFrame | None, text: str) -> DataFrame | None:
    """One row for every channel of ``channels`` that has no message left."""
    if channels is None:
        return None
    left = channels.select("channel_id").distinct().join(msgs.select("channel_id").distinct(), "channel_id", "left_anti")
    return left.select(*row(HEAD, F.lit(text)))


def with_empty(rows: DataFrame, empty: DataFrame | None) -> DataFrame:
    return rows if empty is None else rows.unionByName(empty)


def document_text(rows: DataFrame) -> DataFrame:
    """Whole documents, one row per channel.  For small output and tests only."""
    keyed = F.struct("sect", "k1", "k2", "k3", "text")
    joined = rows.groupBy("channel_id").agg(F.array_sort(F.collect_list(keyed)).alias("r"))
    return joined.select("channel_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))


def write_document(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ``path/channel_id=…/part-*.txt``; part names follow the order."""
    by = [F.col(c) for c in ORDER]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    ranged.sortWithinPartitions(*ORDER).select("channel_id", "text").write.partitionBy("channel_id").text(path)
