"""Totals, heatmap, timeline, leaderboards and breakdowns over messages.

Input rows need an author, a time and an array of parts; the column names are
parameters.  Every result is its own small DataFrame.  All distinct counts run
over pre-aggregated cells, so the shuffle carries cells and not messages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, parts as P
from ..functions.chars import js_round, u16len
from ..functions.tokens import chars_for_tokens

ORDER = ("ts", "file_idx", "msg_idx")


def enrich(
    df: DataFrame,
    tz: str = "UTC",
    strict_reply: bool = False,
    ts: str = "ts",
    parts: str = "parts",
) -> DataFrame:
    """Add the per-message values the other operators read.

    ``strict_reply`` uses the ``has_reply`` flag; otherwise any part that opens
    with ``> `` makes the message a reply, body blockquotes included.
    """
    p, t = F.col(parts), F.col(ts)
    reply = F.col("has_reply") if strict_reply else P.is_reply(p)
    out = df.withColumns(
        {
            "day": clock.day_key(t, tz),
            "hour": clock.hour_of(t, tz),
            "dow": clock.weekday(t, tz),
            "text": P.plain_text(p),
            "media": P.media_count(p),
            "blob": P.last_blob(p),
            "is_reply": reply,
        }
    )
    return out.withColumns(
        {
            "words": P.word_count(F.col("text")),
            "chars": u16len(F.col("text")),
            "reply_to": F.when(F.col("is_reply"), P.reply_target(p)),
        }
    )


def _first_seen(order: Sequence[str]) -> Column:
    return F.struct(*order)


def blob_sum() -> Column:
    entries = P.reaction_entries(F.col("blob"))
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])
    return F.coalesce(total, F.lit(0))


def totals(e: DataFrame, author: str = "author_id", ts: str = "ts") -> DataFrame:
    """One row: messages, participants, active_days, peak_hour, reactions, start, end.

    Rows without a valid time count as messages and nowhere else.
    """
    valid = F.col(ts).isNotNull()
    cells = e.groupBy(F.when(valid, F.col(author)).alias("a"), "day", "hour").agg(
        F.count("*").alias("n"),
        F.sum(F.when(valid, blob_sum())).alias("r"),
        F.min(ts).alias("lo"),
        F.max(ts).alias("hi"),
    )
    one = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count_distinct("a").alias("participants"),
        F.count_distinct("day").alias("active_days"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("reactions"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
    )
    # two single rows from the same cells are lined up
    peak = busiest_hour(cells).withColumn("__one", F.lit(1))
    return one.withColumn("__one", F.lit(1)).join(peak, "__one").drop("__one")


def heatmap(e: DataFrame, dense: bool = False) -> DataFrame:
    """Messages per weekday (0 = Sunday) and hour; ``dense`` adds empty cells."""
    cells = e.where("dow IS NOT NULL").groupBy("dow", "hour").agg(F.count("*").alias("n"))
    if not dense:
        return cells
    grid = e.sparkSession.range(7 * 24).select(
        (F.col("id") % 7).cast("int").alias("dow"),
        F.floor(F.col("id") / 7).cast("int").alias("hour"),
    )
    return grid.join(cells, ["dow", "hour"], "left").select(
        "dow", "hour", F.coalesce("n", F.lit(0)).alias("n")
    )


def heat_intensity(cells: DataFrame, n: str = "n", base=0.15, span=0.85, root=False) -> DataFrame:
    """Shade of a cell relative to the busiest one; empty cells get 0.

    The window holds one aggregated grid: 168 cells, or one row per day.
    """
    share = F.col(n) / F.max(n).over(W.partitionBy())
    shade = F.lit(base) + F.lit(span) * (F.sqrt(share) if root else share)
    return cells.withColumn("shade", F.when(F.col(n) == 0, F.lit(0.0)).otherwise(shade))


def timeline(e: DataFrame) -> DataFrame:
    """Messages per active day; empty days are not filled in."""
    return e.where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"))


def peak_hour(e: DataFrame) -> DataFrame:
    return busiest_hour(e.groupBy("hour").agg(F.count("*").alias("n")))


def busiest_hour(cells: DataFrame) -> DataFrame:
    """Hour with the most messages from any table of ``hour, n``; 0 without messages."""
    hours = cells.where("hour IS NOT NULL").groupBy("hour").agg(F.sum("n").alias("n"))
    best = F.max_by("hour", F.struct(F.col("n"), -F.col("hour")))
    return hours.agg(F.coalesce(best, F.lit(0)).alias("peak_hour"))


def user_stats(
    e: DataFrame,
    author: str = "author_id",
    name: str = "author_name",
    ts: str = "ts",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Per author: counts, words, characters, media, replies, active days, span."""
    valid = e.where(F.col(ts).isNotNull())
    daily = valid.groupBy(author, "day").agg(
        F.count("*").alias("n"),
        F.sum("words").alias("words"),
        F.sum("chars").alias("chars"),
        F.sum("media").alias("media"),
        F.count_if("is_reply").alias("replies"),
        F.min(ts).alias("lo"),
        F.max(ts).alias("hi"),
        F.min(F.struct(*order, F.col(name).alias("name"))).alias("first"),
    )
    out = daily.groupBy(author).agg(
        F.sum("n").alias("messages"),
        F.sum("words").alias("words"),
        F.sum("chars").alias("chars"),
        F.sum("media").alias("media"),
        F.sum("replies").alias("replies"),
        F.count("*").alias("active_days"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        F.min("first").alias("first"),
    )
    return out.select(
        F.col(author),
        F.col("first.name").alias(name),
        "messages",
        "words",
        "chars",
        "media",
        "replies",
        "active_days",
        js_round(F.col("chars") / F.col("messages")).alias("avg_len"),
        "first_seen",
        "last_seen",
        F.col("first").dropFields("name").alias("first_pos"),
    )


def reaction_totals(e: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Reactions per emoji; ``first_pos`` breaks ties in top lists."""
    entries = e.where(F.col("blob").isNotNull() & F.col("ts").isNotNull()).select(
        *order, F.posexplode(P.reaction_entries(F.col("blob")))
    )
    return entries.groupBy(F.col("col.emoji").alias("emoji")).agg(
        F.sum("col.n").alias("n"), F.min(F.struct(*order, "pos")).alias("first_pos")
    )


def media_breakdown(e: DataFrame, order: Sequence[str] = ORDER, parts: str = "parts") -> DataFrame:
    kinds = e.where(F.col("ts").isNotNull()).select(
        *order, F.posexplode(P.media_types(F.col(parts)))
    )
    return kinds.groupBy(F.col("col").alias("kind")).agg(
        F.count("*").alias("n"), F.min(F.struct(*order, "pos")).alias("first_pos")
    )


def reply_edges(e: DataFrame, author: str = "author_id", order: Sequence[str] = ORDER) -> DataFrame:
    """Directed reply counts; self loops are kept here and dropped downstream."""
    hits = e.where((F.col("reply_to") != "") & F.col("ts").isNotNull())
    return hits.groupBy(F.col(author).alias("src"), F.col("reply_to").alias("dst")).agg(
        F.count("*").alias("n"), F.min(_first_seen(order)).alias("first_pos")
    )


def drill_down(e: DataFrame, author_ids: Sequence[str], author: str = "author_id") -> DataFrame:
    """Rows of the selected people; feed the result to the other operators."""
    return e.where(F.col(author).isin(*author_ids))


def summary_card(df: DataFrame, author: str = "author_id", parts: str = "parts") -> DataFrame:
    """One row: kept messages, users, average characters, first and last time."""
    length = u16len(F.array_join(F.col(parts), " "))
    cells = df.groupBy(author).agg(
        F.count("*").alias("n"),
        F.sum(length).alias("c"),
        F.min("ts").alias("lo"),
        F.max("ts").alias("hi"),
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("kept"),
        F.count(author).alias("users"),
        F.coalesce(js_round(F.sum("c") / F.sum("n")), F.lit(0)).alias("avg_chars"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
    )


def top_authors(df: DataFrame, k: int = 15, author: str = "author_id") -> DataFrame:
    """Most active authors; ties by first appearance."""
    counts = df.groupBy(author).agg(
        F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("first_pos")
    )
    return counts.orderBy(F.desc("n"), "first_pos").limit(k)


def budget_breakdown(
    df: DataFrame,
    max_tokens: int,
    k: int = 10,
    author: str = "author_id",
    parts: str = "parts",
) -> DataFrame:
    """Characters used by the most active authors (by count, not characters)."""
    size = u16len(F.array_join(F.col(parts), "\n")) + 15
    counts = df.groupBy(author).agg(
        F.count("*").alias("n"),
        F.sum(size).alias("chars"),
        F.min(F.struct(*ORDER)).alias("first_pos"),
    )
    top = counts.orderBy(F.desc("n"), "first_pos").limit(k)
    share = F.col("chars") * 100 / F.lit(chars_for_tokens(max_tokens))
    return top.withColumn("used_pct", F.round(share, 6))


def budget_used(df: DataFrame, max_tokens: int, parts: str = "parts") -> DataFrame:
    """One row: total characters and the whole percent of the budget used."""
    size = u16len(F.array_join(F.col(parts), "\n")) + 15
    total = F.coalesce(F.sum(size), F.lit(0))
    return df.agg(total.alias("total_chars")).withColumn(
        "used_pct", js_round(F.col("total_chars") / F.lit(chars_for_tokens(max_tokens)) * 100)
    )


def with_bars(counts: DataFrame, k: int, n: str = "n", ties: str = "first_pos") -> DataFrame:
    """Top ``k`` rows with a rank and a bar length of at least 2 percent.

    The window sees the ``k`` rows left by the limit, nothing more.
    """
    top = counts.orderBy(F.desc(n), ties).limit(k)
    pct = F.greatest(F.lit(2), js_round(F.col(n) / F.max(n).over(W.partitionBy()) * 100))
    rank = F.row_number().over(W.partitionBy().orderBy(F.desc(n), ties))
    return top.withColumn("pct", pct).withColumn("rank", rank)


def leaderboard(users: DataFrame, k: int = 12) -> DataFrame:
    return with_bars(users, k, n="messages")


def parse_summary(raw: DataFrame) -> DataFrame:
    """Counts before any de-duplication: messages, names, files, channels."""
    cells = raw.groupBy("author_name", "file_idx", "channel_id").agg(F.count("*").alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count_distinct("author_name").alias("participants"),
        F.count_distinct("file_idx").alias("files"),
        F.count_distinct("channel_id").alias("channels"),
    )


def author_counts(raw: DataFrame, name: str = "author_name") -> DataFrame:
    return raw.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
