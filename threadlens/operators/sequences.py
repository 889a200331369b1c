"""Sessions, author blocks, streaks, gaps, highlights and the day index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, parts as P
from ..functions.chars import js_round, u16len
from ..session import materialize
from . import analytics, graph
from .ordered import (
    MAX_GROUP_ROWS,
    Ordered,
    previous_row,
    row_numbers,
    running_sum,
    slice_groups,
)

ORDER = ("ts", "file_idx", "msg_idx")
BLOCK_GAP_MS = 7 * 60 * 1000  # fixed value


def by_channel_day(
    df: DataFrame,
    channel: str = "channel_id",
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_GROUP_ROWS,
    tz: str = "UTC",
) -> Ordered:
    """Rows ordered inside (channel, calendar day)."""
    if "day" not in df.columns:
        df = df.withColumn("day", clock.day_key(F.col("ts"), tz))
    return slice_groups(df, [channel, "day"], order, max_rows)


def sessions(df: DataFrame, max_rows: int = MAX_GROUP_ROWS, gap_ms: int = clock.SESSION_BREAK_MS):
    """Mark session breaks: a gap above four hours inside one day.

    Adds ``gap_ms`` to the previous message of the day, ``is_break`` and
    ``session_no`` (1-based inside channel and day).
    """
    o = previous_row(by_channel_day(df, max_rows=max_rows), ["ts"], "__prev")
    gap = clock.millis(F.col("ts")) - clock.millis(F.col("__prev.ts"))
    o = o.with_column("gap_ms", gap)
    o = o.with_column("is_break", F.coalesce(F.col("gap_ms") > gap_ms, F.lit(False)))
    o = running_sum(o, F.col("is_break").cast("bigint"), "session_no")
    return o.with_column("session_no", F.col("session_no") + 1).result().drop("__prev")


def author_blocks(df: DataFrame, max_rows: int = MAX_GROUP_ROWS, gap_ms: int = BLOCK_GAP_MS):
    """Group consecutive messages of one author within seven minutes.

    Adds ``grouped`` (continues the block above) and ``block_no``.
    """
    o = previous_row(
        by_channel_day(df, max_rows=max_rows), ["ts", "author_id", "is_system"], "__prev"
    )
    prev = F.col("__prev")
    same = (
        ~F.col("is_system")
        & ~prev["is_system"]
        & (prev["author_id"] == F.col("author_id"))
        & (clock.millis(F.col("ts")) - clock.millis(prev["ts"]) < gap_ms)
    )
    o = o.with_column("grouped", F.coalesce(same, F.lit(False)))
    o = running_sum(o, (~F.col("grouped")).cast("bigint"), "block_no")
    return o.result().drop("__prev")


# ── day level ────────────────────────────────────────────────────────────────
# The windows below run over one row per active day.  Their size is bounded by
# the calendar (3,653 rows for ten years), whatever the number of messages.


def day_counts(e: DataFrame) -> DataFrame:
    return analytics.timeline(e)


def longest_streak(days: DataFrame) -> DataFrame:
    """Most consecutive active days (gaps and islands)."""
    d = F.to_date("day")
    island = F.date_sub(d, F.row_number().over(W.partitionBy().orderBy("day")))
    runs = days.select(island.alias("island")).groupBy("island").agg(F.count("*").alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("streak"))


def longest_silence(days: DataFrame) -> DataFrame:
    """Longest run of empty days between two active ones; ties: the earliest."""
    prev = F.lag("day").over(W.partitionBy().orderBy("day"))
    gaps = days.select(prev.alias("from_day"), F.col("day").alias("to_day"))
    gaps = gaps.withColumn("days", F.date_diff(F.to_date("to_day"), F.to_date("from_day")) - 1)
    return gaps.where("days > 0").orderBy(F.desc("days"), "from_day").limit(1)


def busiest_day(days: DataFrame) -> DataFrame:
    return days.orderBy(F.desc("n"), "day").limit(1)


def weekday_rhythm(e: DataFrame) -> DataFrame:
    return analytics.heatmap(e).groupBy("dow").agg(F.sum("n").alias("n"))


def hour_rhythm(e: DataFrame) -> DataFrame:
    return analytics.heatmap(e).groupBy("hour").agg(F.sum("n").alias("n"))


def busiest_weekday(e: DataFrame) -> DataFrame:
    return weekday_rhythm(e).orderBy(F.desc("n"), "dow").limit(1)


def adjacent_months(days: DataFrame) -> DataFrame:
    """Every month with data and its neighbours that have data."""
    months = days.select(F.substring("day", 1, 7).alias("month")).distinct()
    w = W.partitionBy().orderBy("month")
    return months.select(
        "month", F.lag("month").over(w).alias("previous"), F.lead("month").over(w).alias("next")
    )


# ── people and highlights ───────────────────────────────────────────────────


def _not_system(e: DataFrame) -> DataFrame:
    return e.where(~F.col("is_system") & F.col("ts").isNotNull())


def starters(e: DataFrame, order: Sequence[str] = ORDER, name: str = "author_name") -> DataFrame:
    """Days opened per person, system messages aside."""
    first = _not_system(e).groupBy("day").agg(
        F.min(F.struct(*order, F.col(name).alias("name"))).alias("f")
    )
    return first.groupBy(F.col("f.name").alias(name)).agg(
        F.count("*").alias("n"), F.min("day").alias("first_pos")
    )


def night_owls(e: DataFrame, order: Sequence[str] = ORDER, name: str = "author_name") -> DataFrame:
    """Messages between midnight and six per person."""
    late = _not_system(e).where(F.col("hour") < 6)
    return late.groupBy(name).agg(
        F.count("*").alias("n"), F.min(F.struct(*order)).alias("first_pos")
    )


def top_one(counts: DataFrame, n: str = "n", ties: str = "first_pos") -> DataFrame:
    return counts.orderBy(F.desc(n), ties).limit(1).drop(ties)


def _ranked(score: Column, text: Column, order: Sequence[str]) -> tuple[Column, Column]:
    """Rank of a message by score, then by age, and the row shown of it."""
    rank = F.struct(
        score.alias("score"),
        (-clock.millis(F.col(order[0]))).alias("t"),
        *[(-F.col(c)).alias(c) for c in order[1:]],
    )
    return rank, F.struct(score.alias("score"), "author_name", text.alias("text"), "ts")


def _best_message(e: DataFrame, score: Column, text: Column, order: Sequence[str]) -> DataFrame:
    """Row with the highest positive score, earliest first on ties.

    A single aggregation: each task keeps one candidate.
    """
    rank, row = _ranked(score, text, order)
    best = _not_system(e).where(score > 0).agg(F.max_by(row, rank).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def most_reacted(e: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    body = F.when(F.col("text") == "", F.lit("(media)")).otherwise(F.col("text"))
    return _best_message(e, P.reaction_total(F.col("parts")), P.snippet(body), order)


def longest_message(e: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return _best_message(e, u16len(F.col("text")), P.snippet(F.col("text")), order)


def recap(e: DataFrame) -> DataFrame:
    """All highlights in long form: ``metric, name, value, detail``.

    Three passes over the messages: cells of (person, day, hour), the reaction
    and reply items, and the two best messages.  Cells and items are written,
    and every figure comes from them.  One row per figure, so no step has to
    line up single-row results.
    """
    c = F.col
    pos = F.struct(*ORDER)
    cells = materialize(
        e.groupBy("author_id", "author_name", "is_system", "day", "hour", "dow").agg(
            F.count("*").alias("n"),
            F.sum("words").alias("words"),
            F.sum(F.coalesce(F.size(P.media_types(c("parts"))), F.lit(0))).alias("media"),
            F.sum(analytics.blob_sum()).alias("reactions"),
            F.min(pos).alias("first"),
        ),
        "recap-cells",
    )
    timed = cells.where("day IS NOT NULL")
    people = timed.where("NOT is_system")
    days = timed.groupBy("day").agg(F.sum("n").alias("n"))
    users = timed.groupBy("author_id").agg(
        F.min_by("author_name", "first").alias("author_name"), F.sum("n").alias("messages"),
        F.min("first").alias("first_pos"),
    )
    items = materialize(_recap_items(e), "recap-items")
    edges = items.where("kind = 'reply'").select(c("a").alias("src"), c("b").alias("dst"), "n", c("pos").alias("first_pos"))
    emoji = items.where("kind = 'emoji'").select(c("a").alias("emoji"), "n", c("pos").alias("first_pos"))

    def rows(df: DataFrame, metric: str, value: Column, name=None, detail=None) -> DataFrame:
        blank = F.lit(None).cast("string")
        return df.select(
            F.lit(metric).alias("metric"),
            (blank if name is None else name.cast("string")).alias("name"),
            value.cast("bigint").alias("value"),
            (blank if detail is None else detail.cast("string")).alias("detail"),
        )

    valid = c("day").isNotNull()
    tot = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count_distinct(F.when(valid, c("author_id"))).alias("participants"),
        F.count_distinct("day").alias("active_days"),
        F.coalesce(F.sum(F.when(valid, c("reactions"))), F.lit(0)).alias("reactions"),
        F.coalesce(F.sum(F.when(valid, c("words"))), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(valid, c("media"))), F.lit(0)).alias("total_media"),
    )
    avg = js_round(c("messages") / F.when(c("active_days") > 0, c("active_days")))
    names = ("messages", "participants", "active_days", "reactions", "total_words", "total_media")
    scalars = tot.withColumn("avg_per_day", F.coalesce(avg, F.lit(0))).select(F.explode(F.create_map(
        *(x for n in (*names, "avg_per_day") for x in (F.lit(n), c(n).cast("bigint")))
    )).alias("metric", "value"))
    named_edges = (
        graph.top_duo(edges)
        .join(users.select(c("author_id").alias("src"), c("author_name").alias("src_name")), "src", "left")
        .join(users.select(c("author_id").alias("dst"), c("author_name").alias("dst_name")), "dst", "left")
    )
    opened = people.groupBy("day").agg(F.min(F.struct("first", c("author_name").alias("name"))).alias("f"))
    opened = opened.groupBy(c("f.name").alias("author_name")).agg(F.count("*").alias("n"), F.min("day").alias("first_pos"))
    late = people.where("hour < 6").groupBy("author_name").agg(F.sum("n").alias("n"), F.min("first").alias("first_pos"))
    best = materialize(_highlights(e), "recap-best")
    pieces = [
        scalars.select("metric", F.lit(None).cast("string").alias("name"), "value",
                       F.lit(None).cast("string").alias("detail")),
        rows(analytics.busiest_hour(timed), "peak_hour", c("peak_hour")),
        rows(longest_streak(days), "streak", c("streak")),
        rows(busiest_day(days), "busiest_day", c("n"), c("day")),
        rows(timed.groupBy("dow").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dow").limit(1),
             "busiest_weekday", c("n"), c("dow")),
        rows(longest_silence(days), "quiet_gap", c("days"), c("from_day"), c("to_day")),
        rows(analytics.with_bars(users, 3, n="messages"), "top_user", c("messages"),
             c("author_name"), c("rank")),
        rows(analytics.with_bars(emoji, 3), "top_emoji", c("n"), c("emoji"), c("rank")),
        rows(top_one(opened), "starter", c("n"), c("author_name")),
        rows(top_one(late), "night_owl", c("n"), c("author_name")),
        rows(best.where("most_reacted IS NOT NULL").select("most_reacted.*"), "most_reacted", c("score"),
             c("author_name"), c("text")),
        rows(best.where("longest IS NOT NULL").select("longest.*"), "longest", c("score"), c("author_name"), c("text")),
        rows(named_edges, "top_pair", c("n"), F.coalesce("src_name", "src"),
             F.coalesce("dst_name", "dst")),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def _recap_items(e: DataFrame) -> DataFrame:
    """``kind, a, b, n, pos``: reactions per emoji and replies per pair, in one pass."""
    kind = "array<struct<kind:string,a:string,b:string,n:bigint,at:int>>"
    emoji = F.transform(P.reaction_entries(F.col("blob")), lambda r, i: F.struct(
        F.lit("emoji").alias("kind"), r["emoji"].alias("a"), F.lit(None).cast("string").alias("b"),
        r["n"].cast("bigint").alias("n"), i.alias("at")))
    reply = F.array(F.struct(
        F.lit("reply").alias("kind"), F.col("author_id").alias("a"), F.col("reply_to").alias("b"),
        F.lit(1).cast("bigint").alias("n"), F.lit(-1).alias("at")))
    none = F.array().cast(kind)
    both = F.concat(F.coalesce(emoji.cast(kind), none), F.when(F.col("reply_to") != "", reply.cast(kind)).otherwise(none))
    each = e.where("ts IS NOT NULL").select(*ORDER, F.explode(both).alias("i")).select(*ORDER, "i.*")
    return each.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.min(F.struct(*ORDER, "at")).alias("pos"))


def _highlights(e: DataFrame) -> DataFrame:
    """One row: the most reacted and the longest message, null where there is none."""
    body = F.when(F.col("text") == "", F.lit("(media)")).otherwise(F.col("text"))

    def best(score: Column, text: Column) -> Column:
        rank, row = _ranked(score, text, ORDER)
        return F.max_by(row, F.when(score > 0, rank))

    return _not_system(e).agg(
        best(P.reaction_total(F.col("parts")), P.snippet(body)).alias("most_reacted"),
        best(u16len(F.col("text")), P.snippet(F.col("text"))).alias("longest"),
    )


# ── message explorer ────────────────────────────────────────────────────────


def day_index(e: DataFrame) -> DataFrame:
    """Per day: count, row range in time order and messages per hour.

    Days follow each other in the time order, so the range comes from running
    day totals and no message needs a row number.
    """
    per_hour = [F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    days = e.where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"), *per_hour)
    before = F.sum("n").over(W.partitionBy().orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    first = F.coalesce(before, F.lit(0))
    return days.select(
        "day",
        "n",
        first.alias("first_idx"),
        (first + F.col("n")).alias("end_idx"),
        F.array(*[F.col(f"h{h}") for h in range(24)]).alias("hours"),
    )


def calendar_shades(index: DataFrame) -> DataFrame:
    """Calendar intensity from the square root of the share of the busiest day."""
    return analytics.heat_intensity(index, base=0.14, span=0.82, root=True)


def index_for_hour(index: DataFrame, hour: int) -> DataFrame:
    """Row of each day's first message at or after ``hour``, else its first."""
    earlier = F.aggregate(
        F.slice("hours", 1, hour) if hour > 0 else F.array().cast("array<bigint>"),
        F.lit(0).cast("bigint"),
        lambda acc, n: acc + n,
    )
    offset = F.when(earlier < F.col("n"), earlier).otherwise(0)
    return index.select("day", (F.col("first_idx") + offset).alias("idx"))


def page(
    e: DataFrame, start: int, size: int, order: Sequence[str] = ORDER, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Rows ``start`` … ``start + size - 1`` of the time order, with ``idx``.

    The day index names the days the page touches; only those are ordered.
    """
    touched = day_index(e).where(
        (F.col("first_idx") < start + size) & (F.col("end_idx") > start)
    ).select("day", "first_idx")
    rows = e.join(touched, "day")
    o = row_numbers(slice_groups(rows, ["day"], order, max_rows), "__pos")
    o = o.with_column("idx", F.col("first_idx") + F.col("__pos") - 1)
    return o.where(F.col("idx").between(start, start + size - 1)).result().drop("__pos", "first_idx")


