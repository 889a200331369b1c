"""Keeping a conversation within a token budget, and cutting it into chunks.

All channels are treated at once.  The greedy fill is a suffix sum per channel.
The exact check measures the rendered size without rendering.  A day divider
resets the layout, so of a cut's size all but its own day comes from two layouts
of everything, one of all messages and one of those that always stay, summed up
by day.  The cut's day is found on these sums; only that day is laid out again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import u16len
from ..functions.tokens import (
    TokenCounter,
    chars_for_tokens,
    effective_budget,
    legend_reserve,
    message_cost,
    token_hundredths,
)
from ..session import materialize
from ..sinks import document as D
from ..sinks import txt
from ..sinks.layout import narrow, txt_layout
from .filters import drop_low_activity, matches_keywords
from .ordered import MAX_GROUP_ROWS, largest_group, row_numbers, running_sum, slice_groups

ORDER = ("ts", "file_idx", "msg_idx")
CHUNK_BUCKET = 1024
SLICE_ROWS = 1 << 20
BEYOND = 1 << 62


@dataclass(frozen=True)
class Measure:
    """Size of text in hundredths of the unit the limit is stated in."""

    limit: int
    size: Callable[[Column], Column]
    gap_line: int  # size of the blank line after the legend

    @staticmethod
    def tokens(max_tokens: int, counter: TokenCounter | None = None) -> Measure:
        if counter is None:
            # the blank line runs into the break before the first divider
            return Measure(effective_budget(max_tokens), token_hundredths, 0)
        return Measure(
            effective_budget(max_tokens), lambda t: counter(t).cast("bigint") * 100, 0
        )

    @staticmethod
    def chars(max_chars: int) -> Measure:
        return Measure(max_chars, lambda t: u16len(t) * 100, 100)


@dataclass(frozen=True)
class Trimmed:
    """``messages`` kept; ``report``: channel_id, total, kept, budget_exceeded."""

    messages: DataFrame
    report: DataFrame


def rank_newest(msgs: DataFrame, priority: Column, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds ``priority``, ``from_newest`` (rank among normal messages, 1 = newest) and ``n_normal``.

    A running count per channel, so ties and very large channels are treated as in every ordered window.
    """
    rows = msgs.withColumn("priority", priority)
    normal = ~F.col("priority")
    totals = rows.groupBy("channel_id").agg(F.count_if(normal).alias("n_normal"))
    o = slice_groups(rows, ["channel_id"], ORDER, max_rows)
    o = running_sum(o, F.when(normal, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), "__seen")
    df = o.result().join(totals, "channel_id")
    return df.withColumn("from_newest", F.when(normal, F.col("n_normal") - F.col("__seen") + 1)).drop("__seen")


def fill_newest(
    msgs: DataFrame, priority: Column, reserve: int, max_chars: int, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Greedy fill from the newest normal message back to the first overflow.

    Adds the columns of ``rank_newest``, ``cost`` and ``in_fill``.  Every cost is
    positive, so the fill is the set of messages whose suffix sum still fits.
    """
    rows = rank_newest(msgs, priority, max_rows).withColumn("cost", message_cost(F.col("parts")))
    normal = ~F.col("priority")
    totals = rows.groupBy("channel_id").agg(
        F.coalesce(F.sum(F.when(normal, F.col("cost"))), F.lit(0)).alias("__normal_cost"),
        F.coalesce(F.sum(F.when(~normal, F.col("cost"))), F.lit(0)).alias("__fixed"),
    )
    o = slice_groups(rows, ["channel_id"], ORDER, max_rows)
    o = running_sum(o, F.when(normal, F.col("cost")).otherwise(F.lit(0)), "__spent")
    df = o.result().join(totals, "channel_id")
    suffix = F.col("__normal_cost") - F.col("__spent") + F.col("cost")
    fits = F.lit(reserve) + F.col("__fixed") + suffix <= F.lit(max_chars)
    return df.withColumn("in_fill", F.col("priority") | fits).drop("__normal_cost", "__fixed", "__spent")


def _sizes(measure: Measure) -> dict[str, Column]:
    """Body size of a message: as its own lines, and with the first part glued."""
    lines = F.transform("parts", lambda p: F.concat(F.lit("\n  "), p))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    first = F.concat(F.lit(" "), F.get("parts", F.lit(0)))
    own = measure.size(F.concat_ws("", lines))
    caret = F.coalesce(F.get("parts", F.lit(0)).startswith("^"), F.lit(False))
    glued = measure.size(F.concat_ws("", F.array(first), rest))
    return {"own_size": own, "glued_size": F.when(caret, glued).otherwise(F.lit(0).cast("bigint"))}


def line_sizes(measure: Measure) -> Column:
    """Rendered size of a laid-out row: divider, header and body."""
    divider = F.when(
        F.col("divider") != "none",
        F.concat(F.lit("\n"), txt.divider_text(F.col("divider"), F.col("ts"), F.col("gap_ms"))),
    ).otherwise(F.lit(""))
    head = F.when(
        F.col("has_head"), F.concat(F.lit("\n"), txt.head_text(F.col("time_text"), F.col("author_id")))
    ).otherwise(F.lit(""))
    body = F.when(F.col("glued"), F.col("glued_size")).otherwise(F.col("own_size"))
    return measure.size(F.concat(divider, head)) + body


def header_sizes(
    starts: DataFrame, counts: DataFrame, people: DataFrame, measure: Measure, options: D.RenderOptions
) -> DataFrame:
    """``channel_id, header``: size of the header above, from the start and the authors' counts."""
    line = F.when(F.col("sect") == D.HEAD, F.col("text")).otherwise(F.concat(F.lit("\n"), "text"))
    size = F.when(
        (F.col("sect") == D.LEGEND) & (F.col("text") == ""), F.lit(measure.gap_line).cast("bigint")
    ).otherwise(measure.size(line))
    rows = txt.header_rows_of(starts, D.legend_of(counts, people), options)
    return rows.groupBy("channel_id").agg(F.sum(size).alias("header"))


@dataclass(frozen=True)
class Days:
    """What the search needs besides the narrow ``rows``.

    ``table``: channel_id, day, rank (1 is the newest day), normals, before (normal
    messages of newer days), newer (size of this and all newer days, whole) and
    older (size of the messages that always stay, in the days before this one).
    ``authors``: channel_id, uid, rank, and number and first time of an author's
    messages on a day, of all and of those that always stay.
    """

    rows: DataFrame
    table: DataFrame
    authors: DataFrame
    people: DataFrame
    measure: Measure
    options: D.RenderOptions
    max_rows: int
    largest: int
    empty: int

    def total(self, body: DataFrame, kept: DataFrame) -> DataFrame:
        """``case_id, size`` from the bodies' sizes and the authors' ``case_id, uid, n, start``."""
        kept = kept.where("n > 0").withColumnRenamed("case_id", "channel_id")
        starts = kept.groupBy("channel_id").agg(F.min("start").alias("start"))
        header = header_sizes(starts, kept.select("channel_id", "uid", "n"), self.people, self.measure, self.options)
        return body.join(header.withColumnRenamed("channel_id", "case_id"), "case_id", "left").select(
            "case_id", F.coalesce(F.floor((F.col("body") + F.col("header") + 50) / 100).cast("bigint"), F.lit(self.empty)).alias("size")
        )

    def whole_days(self, wanted: DataFrame) -> DataFrame:
        """Sizes when the newest ``k`` days stay whole, for ``wanted`` (channel_id, k, case_id)."""
        # With no day whole, what always stays of all days is left.
        none = self.table.where("rank = 1").select("channel_id", F.lit(0).cast("bigint").alias("k"), F.col("all_fixed").alias("body"))
        sums = self.table.select("channel_id", F.col("rank").alias("k"), (F.col("newer") + F.col("older")).alias("body")).unionByName(none)
        whole = F.col("rank") <= F.col("k")
        kept = self.authors.join(wanted, "channel_id").groupBy("case_id", "uid").agg(
            F.sum(F.when(whole, F.col("n")).otherwise(F.col("fixed"))).alias("n"),
            F.min(F.when(whole, F.col("first")).otherwise(F.col("first_fixed"))).alias("start"),
        )
        return self.total(wanted.join(sums, ["channel_id", "k"]).select("case_id", "body"), kept)

    def in_day(self, wanted: DataFrame, cuts: DataFrame) -> DataFrame:
        """Sizes when of the cut's day the newest ``k`` normal messages stay; ``cuts`` has channel_id, rank of that day."""
        day = cuts.join(self.table, ["channel_id", "rank"]).select(
            "channel_id", "rank", "day", "before", (F.col("newer") - F.col("whole") + F.col("older")).alias("rest"))
        asked = wanted.join(day, "channel_id")
        kept = self.rows.join(asked, ["channel_id", "day"]).where(F.col("priority") | (F.col("from_newest") <= F.col("before") + F.col("k")))
        kept = kept.drop("channel_id", "k", "rank", "before", "rest").withColumnRenamed("case_id", "channel_id")
        laid = txt_layout(kept, self.max_rows, self.largest).select("channel_id", "author_id", "ts", line_sizes(self.measure).alias("s"))
        mine = materialize(laid.groupBy(F.col("channel_id").alias("case_id"), F.col("author_id").alias("uid")).agg(
            F.sum("s").alias("s"), F.count("*").alias("n"), F.min("ts").alias("start")), "trim-day")
        newer = F.col("a.rank") < F.col("w.rank")
        others = self.authors.alias("a").join(asked.alias("w"), "channel_id").where("a.rank <> w.rank").select(
            "case_id", "uid", F.when(newer, F.col("n")).otherwise(F.col("fixed")).alias("n"),
            F.when(newer, F.col("first")).otherwise(F.col("first_fixed")).alias("start"))
        both = others.unionByName(mine.select("case_id", "uid", "n", "start")).groupBy("case_id", "uid").agg(
            F.sum("n").alias("n"), F.min("start").alias("start"))
        own = mine.groupBy("case_id").agg(F.sum("s").alias("own"))
        body = asked.join(own, "case_id", "left").select("case_id", (F.col("rest") + F.coalesce("own", F.lit(0))).alias("body"))
        return self.total(body, both)


def _days(
    rows: DataFrame, people: DataFrame, measure: Measure, options: D.RenderOptions, max_rows: int, empty: int
) -> Days:
    """Both layouts of everything, summed up by day.  Windows over days hold a row per calendar day."""
    largest = largest_group(rows, ["channel_id", "day"])

    def sizes(of: DataFrame, name: str) -> DataFrame:
        laid = txt_layout(of, max_rows, largest)
        return laid.groupBy("channel_id", "day").agg(F.sum(line_sizes(measure)).alias(name))

    normals = rows.groupBy("channel_id", "day").agg(F.count_if(~F.col("priority")).alias("normals"))
    days = (
        normals.join(sizes(rows, "whole"), ["channel_id", "day"])
        .join(sizes(rows.where("priority"), "fixed_size"), ["channel_id", "day"], "left").fillna(0, ["fixed_size"])
    )
    newest = Window.partitionBy("channel_id").orderBy(F.desc("day"))
    upto = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy("channel_id")
    table = materialize(days.select(
        "channel_id", "day", "normals", "whole", F.row_number().over(newest).cast("bigint").alias("rank"),
        (F.sum("normals").over(upto) - F.col("normals")).alias("before"), F.sum("whole").over(upto).alias("newer"),
        (F.sum("fixed_size").over(everything) - F.sum("fixed_size").over(upto)).alias("older"),
        F.sum("fixed_size").over(everything).alias("all_fixed"),
    ), "trim-days")
    authors = rows.groupBy("channel_id", F.col("author_id").alias("uid"), "day").agg(
        F.count("*").alias("n"), F.count_if("priority").alias("fixed"), F.min("ts").alias("first"),
        F.min(F.when(F.col("priority"), F.col("ts"))).alias("first_fixed"),
    )
    authors = materialize(authors.join(table.select("channel_id", "day", "rank"), ["channel_id", "day"]).drop("day"), "trim-authors")
    return Days(rows, table, authors, people, measure, options, max_rows, largest, empty)


def _search(state: DataFrame, sizes: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """Narrow ``lo`` and ``hi`` of every channel until they are neighbours; ``sizes`` measures channel_id, k, case_id."""
    fits = F.col("size") <= limit
    while not (active := state.where("hi - lo > 1")).isEmpty():
        case = F.concat_ws("\u0001", "channel_id", F.col("k").cast("string"))
        wanted = active.select("channel_id", F.explode(_candidates()).alias("k")).withColumn("case_id", case)
        seen = wanted.join(sizes(wanted), "case_id")
        good, bad = F.when(fits, F.struct("k", "size")), F.when(~fits, F.struct("k", "size"))
        found = seen.groupBy("channel_id").agg(
            F.max(good).alias("good"), F.min(bad).alias("bad"), F.max(F.when(F.col("k") == 0, F.col("size"))).alias("zero"),
        )
        state = materialize(state.join(found, "channel_id", "left").select(
            "channel_id", "n_normal", "guess", "limit",
            F.coalesce("good.k", "lo").alias("lo"), F.coalesce("bad.k", "hi").alias("hi"),
            F.coalesce("good.size", "lo_size").alias("lo_size"), F.coalesce("bad.size", "hi_size").alias("hi_size"),
            F.coalesce("zero", "zero_size").alias("zero_size"),
        ), "trim-state")
    return state


def _candidates() -> Column:
    """Values of ``k`` to measure next, strictly between ``lo`` and ``hi``.

    ``lo`` is the largest known to fit (-1: none), ``hi`` the smallest known
    not to (n + 1: none).  The first round looks around the guess and at both
    ends, the next ones around the linear interpolation of the known sizes.
    """
    lo, hi, n = F.col("lo"), F.col("hi"), F.col("n_normal")
    slope = (F.col("hi_size") - F.col("lo_size")) / (hi - lo)
    mid = lo + F.floor((F.col("limit") - F.col("lo_size")) / F.when(slope > 0, slope))
    even = F.array(*[lo + F.ceil((hi - lo) * i / 4) for i in (1, 2, 3)])

    def around(k: Column, steps: tuple[int, ...]) -> Column:
        return F.array(*[F.least(F.greatest(k + d, lo + 1), hi - 1) for d in steps])

    both_ends = F.array(F.lit(0).cast("bigint"), n)
    pick = (
        F.when((lo < 0) | (hi > n), F.concat(around(F.col("guess"), (-2, -1, 0, 1, 2)), both_ends))
        .when(mid.isNull(), even)
        .otherwise(F.concat(around(mid, (-6, -2, 0, 1, 2, 6)), even))
    )
    return F.array_distinct(F.filter(pick, lambda k: (k > lo) & (k < hi)))


def trim(
    msgs: DataFrame,
    people: DataFrame,
    max_tokens: int | None = None,
    max_chars: int | None = None,
    keywords: tuple[str, ...] = (),
    min_messages: int = 0,
    counter: TokenCounter | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> Trimmed:
    """Trim every channel to the budget.

    Keyword matches always stay.  Of the other messages the newest ``k`` stay,
    ``k`` being the largest number whose exact rendered size is within the
    limit; it grows with ``k``, so that is where dropping the oldest messages
    and adding back newer ones meet.  Without ``max_tokens`` the limit is
    ``max_chars`` characters.
    """
    if max_tokens:
        measure = Measure.tokens(max_tokens, counter)
        shown_limit = max_tokens
    else:
        measure = Measure.chars(max_chars)
        shown_limit = int(max_chars / 4 + 0.5)
    options = D.RenderOptions(max_tokens=shown_limit)
    # The bodies are sized before the ordered window, which then sorts narrow rows only.
    sized = msgs.withColumns(_sizes(measure)).withColumn("priority", matches_keywords(F.col("parts"), keywords))
    sized = narrow(sized, "priority", "own_size", "glued_size")
    rows = materialize(rank_newest(sized, F.col("priority"), max_rows), "trim-rows")
    empty = msgs.sparkSession.range(1).select(F.floor((measure.size(F.lit(txt.EMPTY_TEXT)) + 50) / 100)).first()[0]
    days = _days(rows, people, measure, options, max_rows, empty)

    # How many of the newest days stay whole: the sums without a header point to the place.
    unknown = F.lit(None).cast("bigint")
    limit = F.lit(measure.limit).cast("bigint")
    body_fits = F.when(F.col("newer") + F.col("older") <= measure.limit * 100, F.col("rank"))
    state = days.table.groupBy("channel_id").agg(
        F.max("rank").alias("n_normal"), F.coalesce(F.max(body_fits), F.lit(0)).cast("bigint").alias("guess")
    ).select(
        "channel_id", "n_normal", "guess", limit.alias("limit"), F.lit(-1).cast("bigint").alias("lo"), (F.col("n_normal") + 1).alias("hi"),
        unknown.alias("lo_size"), unknown.alias("hi_size"), unknown.alias("zero_size"),
    )
    whole = _search(state, days.whole_days, measure.limit)
    # How many messages of the day before them stay.
    cuts = whole.where("lo >= 0 AND lo < n_normal").select("channel_id", (F.col("lo") + 1).alias("rank"))
    part = whole.join(cuts, "channel_id").join(days.table.select("channel_id", "rank", "normals"), ["channel_id", "rank"]).select(
        "channel_id", F.col("normals").alias("n_normal"), F.lit(0).cast("bigint").alias("guess"), "limit",
        F.lit(0).cast("bigint").alias("lo"), F.col("normals").cast("bigint").alias("hi"), "lo_size", "hi_size", unknown.alias("zero_size"),
    )
    inside = _search(part, lambda wanted: days.in_day(wanted, cuts), measure.limit)
    upto = days.table.select("channel_id", F.col("rank").alias("lo"), (F.col("before") + F.col("normals")).alias("k0"))
    totals = rows.groupBy("channel_id").agg(F.count("*").alias("total"), F.max("n_normal").alias("normals"))
    state = materialize(
        whole.join(upto, ["channel_id", "lo"], "left")
        .join(inside.select("channel_id", F.col("lo").alias("more"), F.col("lo_size").alias("more_size")), "channel_id", "left")
        .join(totals, "channel_id")
        .select("channel_id", "total", "normals", "lo", (F.coalesce("k0", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("k"),
                F.coalesce("more_size", "lo_size", "zero_size").alias("size")), "trim-cuts",
    )
    keep = state.select("channel_id", "k")
    kept_keys = rows.join(keep, "channel_id").where(
        F.col("priority") | (F.col("from_newest") <= F.col("k"))
    ).select("channel_id", *ORDER)
    kept = msgs.join(kept_keys, ["channel_id", *ORDER], "left_semi")
    kept = drop_low_activity(kept, min_messages)
    left = kept.groupBy("channel_id").agg(F.count("*").alias("kept"))
    # nothing fits: the priority messages alone are over the limit
    report = state.join(left, "channel_id", "left").select(
        "channel_id", "total", F.coalesce("kept", F.lit(0)).alias("kept"),
        "size", ((F.col("lo") < 0) & (F.col("total") > F.col("normals"))).alias("budget_exceeded"),
    )
    return Trimmed(kept, report)


# ── chunks ──────────────────────────────────────────────────────────────────


def index_costs(msgs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``channel_id``, order, ``idx`` from 0, ``upto`` (cost up to here) and ``cost``."""
    rows = msgs.select("channel_id", *ORDER, message_cost(F.col("parts")).alias("cost"))
    o = slice_groups(rows, ["channel_id"], ORDER, max_rows)
    o = running_sum(row_numbers(o, "idx"), F.col("cost"), "upto")
    return o.result().withColumn("idx", F.col("idx") - 1)


def chunk_ends(costs: DataFrame, max_chars: int, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Where a chunk that starts at each message would end.

    The end is the number of messages whose running cost stays within the
    start's allowance: both are lined up on the cost axis and counted.
    """
    room = max_chars - legend_reserve(0)
    marks = costs.select("channel_id", F.col("upto").alias("at"), F.lit(0).alias("kind"),
                         F.col("idx"))
    asks = costs.select("channel_id", (F.col("upto") - F.col("cost") + room).alias("at"),
                        F.lit(1).alias("kind"), F.col("idx"))
    o = slice_groups(marks.unionByName(asks), ["channel_id"], ["at", "kind", "idx"], max_rows)
    o = running_sum(o, (F.col("kind") == 0).cast("bigint"), "__n")
    ends = o.where("kind = 1").result()
    return ends.select("channel_id", "idx", F.greatest(F.col("idx") + 1, F.col("__n")).alias("end"))


def _exits(to: np.ndarray) -> np.ndarray:
    """Where a walk leaves a slice, from each of its places; ``to`` holds the next place, beyond the slice if that is outside.

    Jumps lead forward only, so taking every jump twice at once halves the steps that remain.
    """
    out = to.copy()
    while (inside := out < len(to)).any():
        out[inside] = out[out[inside]]
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(channel, first place, next place from each, end of the chunk from each, entries) of every slice in sorted batches."""
    held: list[pa.RecordBatch] = []

    def whole():
        t = pa.Table.from_batches(held)
        entries = t.column("entry")[0].as_py() if "entry" in t.column_names else None
        return t.column("channel_id")[0].as_py(), t.column("idx")[0].as_py(), t.column("to").to_numpy(), t.column("end").to_numpy(), entries

    def name(part: pa.RecordBatch) -> tuple:
        return part.column("channel_id")[0].as_py(), part.column("slice")[0].as_py()

    for batch in batches:
        channel = batch.column("channel_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        place = batch.column("slice").to_numpy()
        cuts = np.flatnonzero((channel[1:] != channel[:-1]) | (place[1:] != place[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(begin, end - begin)
            if held and part.num_rows and name(held[0]) != name(part):
                yield whole()
                held.clear()
            if part.num_rows:
                held.append(part)
    if held:
        yield whole()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exit of every entry of a slice, as steps: a later entry never leaves earlier, so few rows hold all."""
    for channel, first, to, _, _ in _slices(batches):
        exits = _exits(to - first) + first
        at = np.flatnonzero(np.diff(exits, prepend=exits[0] - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([channel] * len(at), pa.string()), pa.array([first] * len(at), pa.int64()), pa.array(at + first), pa.array(exits[at])],
            ["channel_id", "first", "entry", "exit"],
        )


def _entries(steps: pd.DataFrame) -> pd.DataFrame:
    """Where a channel's walk enters its slices, from the steps of all of them in order."""
    steps = steps.sort_values("entry")
    first, entry, out = steps["first"].to_numpy(), steps["entry"].to_numpy(), steps["exit"].to_numpy()
    place, rows = 0, []
    while len(entry):
        k = int(np.searchsorted(entry, place, "right")) - 1
        rows.append((first[k], place))
        if out[k] >= BEYOND:
            break
        place = int(out[k])
    found = pd.DataFrame(rows, columns=["first", "entry"]).astype("int64")
    found.insert(0, "channel_id", steps["channel_id"].iloc[0])
    return found


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that start in each slice, from its entry on."""
    for channel, first, to, end, entry in _slices(batches):
        starts, at = [], entry - first
        while at < len(to):
            starts.append(at)
            at = int(to[at]) - first
        yield pa.RecordBatch.from_arrays(
            [pa.array([channel] * len(starts), pa.string()), pa.array([s + first for s in starts], pa.int64()), pa.array(end[starts])],
            ["channel_id", "start", "end"],
        )


def chunk_bounds(
    costs: DataFrame, max_tokens: int, overlap: int = 500, max_rows: int = MAX_GROUP_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``channel_id, chunk, start, end`` of overlapping chunks (end excluded).

    Each message knows where the next chunk would start if one started at it.
    A channel is cut into slices; inside a slice those jumps are composed, which
    gives for every place at which a walk may enter the place at which it leaves.
    That map rises in few steps, so a channel's walk over its slices is a walk
    over a small table, a few rows for every ``slice_rows`` messages.  Knowing its
    entry, each slice then lists its own chunks.
    """
    max_chars = chars_for_tokens(effective_budget(max_tokens))
    sizes = costs.groupBy("channel_id").agg(F.count("*").alias("n"))
    ends = chunk_ends(costs, max_chars, max_rows).join(sizes, "channel_id")
    # The chunk that reaches the end is the last.
    to = F.when(F.col("end") < F.col("n"), F.greatest(F.col("idx") + 1, F.col("end") - overlap)).otherwise(F.lit(BEYOND))
    jumps = materialize(ends.select("channel_id", F.floor(F.col("idx") / slice_rows).alias("slice"), "idx", to.alias("to"), "end"), "chunk-jumps")
    parts = int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_slice(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "channel_id", "slice").sortWithinPartitions("channel_id", "slice", "idx")

    steps = by_slice(jumps).mapInArrow(_steps, "channel_id string, first bigint, entry bigint, exit bigint")
    entries = steps.groupBy("channel_id").applyInPandas(_entries, "channel_id string, first bigint, entry bigint")
    entries = materialize(entries.select("channel_id", F.floor(F.col("first") / slice_rows).alias("slice"), "entry"), "chunk-entries")
    used = by_slice(jumps.join(entries, ["channel_id", "slice"])).select("channel_id", "slice", "idx", "to", "end", "entry")
    used = used.mapInArrow(_walks, "channel_id string, start bigint, end bigint")
    o = row_numbers(slice_groups(materialize(used, "chunk-starts"), ["channel_id"], ["start"], max_rows), "chunk")
    return o.result().select("channel_id", "chunk", "start", "end")


def assign_chunks(costs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Message positions with the chunks they are in; overlaps repeat.

    A range join made into an equi-join on buckets of positions, so no join
    key holds more than one bucket of messages.
    """
    size = CHUNK_BUCKET
    buckets = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))
    spread = bounds.withColumn("__b", F.explode(buckets))
    keyed = costs.withColumn("__b", F.floor(F.col("idx") / size))
    hit = keyed.join(spread, ["channel_id", "__b"])
    return hit.where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end"))).drop("__b", "start", "end")


def chunk_messages(
    msgs: DataFrame, max_tokens: int, overlap: int = 500, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Messages with their ``chunk`` number, from 1 per channel."""
    costs = materialize(index_costs(msgs, max_rows), "chunk-costs")
    inside = assign_chunks(costs, chunk_bounds(costs, max_tokens, overlap, max_rows))
    return msgs.join(inside.select("channel_id", *ORDER, "idx", "chunk"), ["channel_id", *ORDER])

