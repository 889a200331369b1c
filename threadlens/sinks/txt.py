"""Compact text transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.redact import URL_STOP_TXT, redact
from ..operators.ordered import MAX_GROUP_ROWS
from . import document as D
from .layout import ORDER, narrow, txt_layout

EMPTY_TEXT = "No messages found or file empty."


def _redact(text: Column, o: D.RenderOptions) -> Column:
    return redact(text, o.redact_urls, o.redact_emails, URL_STOP_TXT)


def divider_text(divider: Column, ts: Column, gap_ms: Column) -> Column:
    """Day or session divider line with its blank line, or an empty text."""
    day = F.concat(F.lit("\n=== "), clock.day_divider(ts), F.lit(" ==="))
    brk = F.concat(F.lit("\n=== SESSION BREAK ("), clock.long_duration(gap_ms), F.lit(") ==="))
    return F.when(divider == "day", day).when(divider == "break", brk).otherwise(F.lit(""))


def head_text(time_text: Column, author: Column) -> Column:
    return F.concat(F.lit("\n"), time_text, F.lit(" "), author, F.lit(":"))


def header_rows(msgs: DataFrame, people: DataFrame, options: D.RenderOptions) -> DataFrame:
    return header_rows_of(D.channel_starts(msgs), D.legend(msgs, people), options)


def header_rows_of(starts: DataFrame, legend: DataFrame, options: D.RenderOptions) -> DataFrame:
    """Header of the channels of ``starts`` (channel_id, start) with their participants."""
    start = F.concat(F.lit("# Start: "), clock.http_date(F.col("start")))
    intro = [F.lit(f"# LLM-Optimized Chat Log (Limit: ~{options.limit_text} tokens)"), start,
             F.lit("# Participants:")]
    if options.preamble.strip():
        intro = [F.lit(options.preamble.strip()), F.lit(""), *intro]
    head = starts.select(*D.row(D.HEAD, F.concat_ws("\n", *intro)))
    name = F.lit("") if options.redact_names else F.concat(F.lit(" "), F.col("label"))
    entry = F.concat(
        F.lit("# "), F.col("uid"), F.lit(":"), name, F.lit(" ("), F.col("n").cast("string"),
        F.lit(" msgs, "), F.col("pct"), F.lit("%)"),
    )
    people_rows = legend.select(*D.row(D.LEGEND, entry, *D.number_then_count(), F.xxhash64("uid")))
    gap = starts.select(*D.row(D.LEGEND, F.lit(""), F.lit((1 << 62))))
    return head.unionByName(people_rows).unionByName(gap)


def body_rows(msgs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rows that own a line, glued reaction parts appended."""
    extra = msgs.select("channel_id", *ORDER, "parts")
    laid = txt_layout(narrow(msgs), max_rows).join(extra, ["channel_id", *ORDER])
    divider = divider_text(F.col("divider"), F.col("ts"), F.col("gap_ms"))
    first = F.get("parts", F.lit(0))
    own_glue = F.col("glued") & (F.col("divider") != "none")
    divider = F.when(own_glue, F.concat(divider, F.lit(" "), first)).otherwise(divider)
    rest = F.when(
        F.col("glued"), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    ).otherwise(F.col("parts"))
    lines = F.concat(
        F.when(F.col("divider") != "none", F.array(divider)).otherwise(F.array().cast("array<string>")),
        F.when(F.col("has_head"), F.array(head_text(F.col("time_text"), F.col("author_id")))).otherwise(
            F.array().cast("array<string>")
        ),
        F.transform(rest, lambda p: F.concat(F.lit("  "), p)),
    )
    owned = laid.where("owns_line").withColumn("text", F.array_join(lines, "\n"))
    owned = owned.select("channel_id", "day", "line_no", *ORDER, "text")
    # A part glued to the line above belongs to the owner of that line, which
    # is the row's own number unless the row opens a line itself.
    loose = laid.where(F.col("glued") & ~own_glue).select(
        "channel_id", "day",
        (F.col("line_no") - F.col("owns_line").cast("bigint")).alias("line_no"),
        F.struct(*ORDER, first.alias("t")).alias("g"),
    )
    tails = loose.groupBy("channel_id", "day", "line_no").agg(F.array_sort(F.collect_list("g")).alias("g"))
    tails = tails.select("channel_id", "day", "line_no", F.array_join(F.transform("g", lambda g: g["t"]), " ").alias("tail"))
    joined = owned.join(tails, ["channel_id", "day", "line_no"], "left")
    text = F.when(F.col("tail").isNotNull(), F.concat("text", F.lit(" "), "tail")).otherwise(F.col("text"))
    return joined.select(*D.body_row(text))


def render(
    msgs: DataFrame, people: DataFrame, options: D.RenderOptions = D.RenderOptions(),
    max_rows: int = MAX_GROUP_ROWS, channels: DataFrame | None = None,
) -> DataFrame:
    """Document rows; a channel of ``channels`` without a message gets the empty document."""
    rows = header_rows(msgs, people, options).unionByName(body_rows(msgs, max_rows))
    return D.with_empty(rows.withColumn("text", _redact(F.col("text"), options)), D.empty_documents(msgs, channels, EMPTY_TEXT))
