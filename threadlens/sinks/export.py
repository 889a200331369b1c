"""Format dispatch and the export summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redact import safe_filename
from ..operators import budget
from . import document as D
from . import markdown, page, tables, txt

FORMATS = ("txt", "md", "csv", "json", "html")


def render_document(
    msgs: DataFrame, people: DataFrame, fmt: str, options: D.RenderOptions, channels: DataFrame | None = None
) -> DataFrame:
    """Document rows of a text format."""
    if fmt == "md":
        return markdown.render(msgs, people, options, channels)
    if fmt == "html":
        return page.render(msgs, people, options, channels=channels)
    if fmt == "txt":
        return txt.render(msgs, people, options, channels=channels)
    raise ValueError(f"not a document format: {fmt}")


def write_export(
    msgs: DataFrame, people: DataFrame, fmt: str, path: str, options: D.RenderOptions = D.RenderOptions(),
    channels: DataFrame | None = None,
) -> None:
    """One folder per channel under ``path``; unknown formats fall back to text.

    ``channels``, the unfiltered messages or any table with ``channel_id``, names
    the channels that get a document even if no message of theirs is left.
    """
    if fmt == "csv":
        tables.write_csv(msgs, path, options)
    elif fmt == "json":
        tables.write_json_lines(msgs, f"{path}/messages", options)
        shown = F.col("uid") if options.redact_names else F.col("label")
        people.select("uid", shown.alias("label")).write.json(f"{path}/participants")
    else:
        fmt = fmt if fmt in FORMATS else "txt"
        D.write_document(render_document(msgs, people, fmt, options, channels), path)


def named_chunks(msgs: DataFrame, files: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """Messages with their chunk, as documents: ``channel_id`` becomes the document's safe name.

    The name is that of the channel's first file (the channel's id without one)
    and the chunk's number.  Two channels of one name are told apart by their ids.
    Messages in an overlap are in both chunks.
    """
    base = files.groupBy("channel_id").agg(F.min_by("base_name", "file_idx").alias("base"))
    alone = base.groupBy("base").agg(F.count("*").alias("sharing"))
    base = base.join(alone, "base", "left")
    cut = budget.chunk_messages(msgs, max_tokens, overlap).join(base, "channel_id", "left")
    stem = F.when(F.coalesce("sharing", F.lit(1)) == 1, F.coalesce("base", "channel_id")).otherwise(F.concat_ws(" ", "base", "channel_id"))
    part = F.concat(F.lit("_part"), F.col("chunk").cast("string"))
    return cut.withColumn("channel_id", F.concat(safe_filename(stem), part)).drop("base", "sharing", "chunk", "idx")


def write_chunks(
    msgs: DataFrame, people: DataFrame, files: DataFrame, fmt: str, path: str, max_tokens: int, overlap: int = 500,
    options: D.RenderOptions = D.RenderOptions(),
) -> None:
    """One document per channel and chunk, under its safe name."""
    write_export(named_chunks(msgs, files, max_tokens, overlap), people, fmt, path, options)


def export_summary(kept: int, total: int, budget_exceeded: bool) -> dict:
    """Complete or trimmed, and how many messages were left out."""
    return {
        "complete": kept >= total and not budget_exceeded,
        "kept": kept,
        "total": total,
        "excluded": max(0, total - kept),
        "budget_exceeded": budget_exceeded,
    }


def summarise(all_messages: DataFrame, kept: DataFrame, exceeded: DataFrame | None = None) -> DataFrame:
    """Export summary per channel."""
    total = all_messages.groupBy("channel_id").agg(F.count("*").alias("total"))
    left = kept.groupBy("channel_id").agg(F.count("*").alias("kept"))
    out = total.join(left, "channel_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    if exceeded is None:
        out = out.withColumn("budget_exceeded", F.lit(False))
    else:
        out = out.join(exceeded.select("channel_id", "budget_exceeded"), "channel_id", "left")
        out = out.withColumn("budget_exceeded", F.coalesce("budget_exceeded", F.lit(False)))
    return out.withColumn(
        "complete", (F.col("kept") >= F.col("total")) & ~F.col("budget_exceeded")
    ).withColumn("excluded", F.greatest(F.lit(0), F.col("total") - F.col("kept")))
