"""Markdown transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.redact import URL_STOP_MARKDOWN, redact
from . import document as D

ORDER = ("ts", "file_idx", "msg_idx")
EMPTY_TEXT = "No messages found."


def header_rows(msgs: DataFrame, people: DataFrame, options: D.RenderOptions) -> DataFrame:
    start = F.concat(F.lit("**Start:** "), clock.http_date(F.col("start")))
    intro = [F.lit(f"# Chat Log (~{options.limit_text} token limit)"), start, F.lit(""), F.lit("## Participants")]
    if options.preamble.strip():
        intro = [F.lit(options.preamble.strip()), F.lit(""), F.lit("---"), F.lit(""), *intro]
    starts = D.channel_starts(msgs)
    head = starts.select(*D.row(D.HEAD, F.concat_ws("\n", *intro)))
    name = F.lit("") if options.redact_names else F.concat("label", F.lit(" "))
    entry = F.concat(
        F.lit("- **"), F.col("uid"), F.lit("**: "), name, F.lit("("), F.col("n").cast("string"),
        F.lit(" msgs, "), F.col("pct"), F.lit("%)"),
    )
    people_rows = D.legend(msgs, people).select(*D.row(D.LEGEND, entry, *D.number_then_count(), F.xxhash64("uid")))
    rule = starts.select(*D.row(D.LEGEND, F.lit("\n---\n"), F.lit(1 << 62)))
    return head.unionByName(people_rows).unionByName(rule)


def body_rows(msgs: DataFrame) -> DataFrame:
    """One row per message; the first of a day carries the day heading.

    Only the first position of each day is needed, not an order of the rows.
    """
    rows = msgs.withColumn("day", clock.day_key(F.col("ts")))
    firsts = rows.groupBy("channel_id", "day").agg(F.min(F.struct(*ORDER)).alias("first"))
    rows = rows.join(firsts, ["channel_id", "day"])
    opens = F.struct(*ORDER) == F.col("first")
    heading = F.when(opens, F.array(F.concat(F.lit("## "), clock.day_divider(F.col("ts")), F.lit("\n"))))
    title = F.concat(F.lit("**["), clock.clock_time(F.col("ts")), F.lit("] "), F.col("author_id"), F.lit(":**"))
    empty = F.array().cast("array<string>")
    lines = F.concat(F.coalesce(heading, empty), F.array(title), F.col("parts"), F.array(F.lit("")))
    return rows.select(*D.body_row(F.array_join(lines, "\n")))


def render(
    msgs: DataFrame, people: DataFrame, options: D.RenderOptions = D.RenderOptions(), channels: DataFrame | None = None
) -> DataFrame:
    """Document rows; a channel of ``channels`` without a message gets the empty document."""
    rows = header_rows(msgs, people, options).unionByName(body_rows(msgs))
    text = redact(F.col("text"), options.redact_urls, options.redact_emails, URL_STOP_MARKDOWN)
    return D.with_empty(rows.withColumn("text", text), D.empty_documents(msgs, channels, EMPTY_TEXT))
