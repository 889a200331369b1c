"""What the previous messages decide about a message: dividers, headers, glue.

Day dividers reset everything, so all of it is local to (channel, UTC day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..operators.ordered import MAX_GROUP_ROWS, last_known, previous_row, running_sum, slice_groups

ORDER = ("ts", "file_idx", "msg_idx")


def narrow(msgs: DataFrame, *also: str) -> DataFrame:
    """Only what the layout looks at and ``also``; message bodies stay behind."""
    first = F.get("parts", F.lit(0))
    last = F.try_element_at("parts", F.lit(-1))
    return msgs.select(
        "channel_id", *ORDER, "author_id",
        clock.day_key(F.col("ts")).alias("day"),
        F.size("parts").alias("n_parts"),
        F.coalesce(first.startswith("^"), F.lit(False)).alias("caret"),
        last.endswith(":").alias("colon"),
        *also,
    )


def txt_layout(rows: DataFrame, max_rows: int = MAX_GROUP_ROWS, largest: int | None = None) -> DataFrame:
    """Layout of the compact text format.

    Adds ``divider`` (day | break | none), ``gap_ms``, ``time_text``, ``glued``
    (first part joins the line above), ``has_head`` and ``line_no``, the number
    of the row that owns the line a glued part joins.
    ``rows`` come from ``narrow`` and may carry further columns.
    """
    o = slice_groups(rows, ["channel_id", "day"], ORDER, max_rows, largest)
    o = previous_row(o, ["ts"], "__prev")
    gap = clock.millis(F.col("ts")) - clock.millis(F.col("__prev.ts"))
    o = o.with_column("gap_ms", gap)
    o = o.with_df(o.df.drop("__prev"))
    new_day, brk = F.col("gap_ms").isNull(), F.col("gap_ms") > clock.SESSION_BREAK_MS
    o = o.with_column("divider", F.when(new_day, "day").when(brk, "break").otherwise("none"))
    absolute = new_day | (F.col("gap_ms") > clock.ABSOLUTE_TIME_MS)
    clock_text = F.concat(F.lit("["), clock.clock_time(F.col("ts")), F.lit("]"))
    o = o.with_column(
        "time_text", F.when(absolute, clock_text).otherwise(clock.time_delta(F.col("gap_ms")))
    )
    # whether the line above ends with a colon, when no divider comes between
    ends = F.when(F.col("n_parts") > 0, F.col("colon")).when(F.col("divider") != "none", F.lit(False))
    o = last_known(o, ends, "__above", strict=True)
    o = o.with_column(
        "glued",
        F.col("caret") & ((F.col("divider") != "none") | ~F.coalesce("__above", F.lit(False))),
    )
    o = o.with_column("__rest", F.col("n_parts") - F.col("glued").cast("int"))
    o = running_sum(o, (F.col("divider") != "none").cast("bigint"), "__block")
    shown = F.when(F.col("__rest") > 0, F.struct("__block", "author_id"))
    o = last_known(o, shown, "__last", strict=True)
    same = (F.col("__last.__block") == F.col("__block")) & (F.col("__last.author_id") == F.col("author_id"))
    o = o.with_column("has_head", (F.col("__rest") > 0) & ~F.coalesce(same, F.lit(False)))
    owns = (F.col("divider") != "none") | (F.col("__rest") > 0)
    o = o.with_column("owns_line", owns)
    o = running_sum(o, F.col("owns_line").cast("bigint"), "line_no")
    return o.result().drop("__above", "__rest", "__block", "__last", "colon", "caret", "n_parts")


def page_layout(msgs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Layout of the HTML transcript: divider, gap and the author above."""
    rows = msgs.withColumn("day", clock.day_key(F.col("ts")))
    o = previous_row(slice_groups(rows, ["channel_id", "day"], ORDER, max_rows), ["ts", "author_id"], "__prev")
    gap = clock.millis(F.col("ts")) - clock.millis(F.col("__prev.ts"))
    df = o.result().withColumn("gap_ms", gap).withColumn("above", F.col("__prev.author_id")).drop("__prev")
    brk = F.col("gap_ms") > clock.SESSION_BREAK_MS
    return df.withColumn(
        "divider", F.when(F.col("gap_ms").isNull(), "day").when(brk, "break").otherwise("none")
    )
