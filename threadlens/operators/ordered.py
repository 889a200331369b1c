"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(channel)`` sorts a whole channel in one task.
That is the best plan for ordinary groups, and a trap when one channel holds a
third of all rows.  ``slice_groups`` looks at the largest group first.  Within
bounds, the operations below become plain windows.  Beyond them, the rows are
range-partitioned on ``(keys, order)``, so a large group is cut into
consecutive slices; each operation then works inside a slice and adds what the
earlier slices of the group carry over.  The carry is computed on one row per
(group, slice).

The slice number is the partition number of the range shuffle.  It is written
out with the rows, since it must not change when a task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

# Rows of one group a single task may sort.  A few columns of two million rows
# stay well inside one executor's memory and spill gracefully.
MAX_GROUP_ROWS = 2_000_000

SLICE = "__slice"


@dataclass(frozen=True)
class Ordered:
    """Rows with a total order inside each group, cut into slices if needed."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool

    def window(self):
        keys = [*self.keys, SLICE] if self.sliced else list(self.keys)
        return W.partitionBy(*keys).orderBy(*self.order)

    def carry_window(self):
        return W.partitionBy(*self.keys).orderBy(SLICE)

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def where(self, condition: Column | str) -> Ordered:
        return self.with_df(self.df.where(condition))

    def with_column(self, name: str, value: Column) -> Ordered:
        return self.with_df(self.df.withColumn(name, value))

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group: one partial aggregation, one scalar."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()
    return top[0] or 0


def slice_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> Ordered:
    """Prepare ``df`` for ordered work; ``order`` must be total inside a group.

    ``largest`` passes in the size of the largest group where it is known.
    """
    keys, order = tuple(keys), tuple(order)
    rows = largest_group(df, keys) if largest is None else largest
    if rows <= max_rows:
        return Ordered(df, keys, order, sliced=False)
    total = df.count()
    parts = max(2, -(-2 * total // max_rows))
    cut = df.repartitionByRange(parts, *keys, *order)
    cut = cut.withColumn(SLICE, F.spark_partition_id())
    return Ordered(materialize(cut, "slices"), keys, order, sliced=True)


def _join_carry(o: Ordered, carry: DataFrame) -> DataFrame:
    """Attach one carry row per (group, slice); group keys may be null."""
    right = carry
    cond = F.lit(True)
    for k in (*o.keys, SLICE):
        right = right.withColumnRenamed(k, f"__c_{k}")
        cond = cond & o.df[k].eqNullSafe(right[f"__c_{k}"])
    return o.df.join(right, cond, "left").drop(*[f"__c_{k}" for k in (*o.keys, SLICE)])


def running_sum(o: Ordered, value: Column, out: str) -> Ordered:
    """Sum of ``value`` from the group's first row to this one, included."""
    inside = F.sum(value).over(o.window().rowsBetween(W.unboundedPreceding, W.currentRow))
    if not o.sliced:
        return o.with_column(out, inside)
    totals = o.df.groupBy(*o.keys, SLICE).agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(o.carry_window().rowsBetween(W.unboundedPreceding, -1))
    carry = totals.withColumn("__before", before).drop("__total")
    df = _join_carry(o.with_column(out, inside), carry)
    df = df.withColumn(out, F.col(out) + F.coalesce(F.col("__before"), F.lit(0)))
    return o.with_df(df.drop("__before"))


def row_numbers(o: Ordered, out: str) -> Ordered:
    """1-based position inside the group."""
    if not o.sliced:
        return o.with_column(out, F.row_number().over(o.window()).cast("bigint"))
    return running_sum(o, F.lit(1).cast("bigint"), out)


def _neighbour(o: Ordered, cols: Sequence[str], out: str, step: int) -> Ordered:
    pick = F.struct(*cols)
    shift = F.lag if step < 0 else F.lead
    inside = shift(pick, 1).over(o.window())
    if not o.sliced:
        return o.with_column(out, inside)
    edge = F.max_by if step < 0 else F.min_by
    edges = o.df.groupBy(*o.keys, SLICE).agg(
        edge(pick, F.struct(*o.order)).alias("__edge")
    )
    carry = edges.withColumn("__near", shift("__edge", 1).over(o.carry_window())).drop("__edge")
    df = _join_carry(o.with_column(out, inside), carry)
    df = df.withColumn(out, F.coalesce(F.col(out), F.col("__near")))
    return o.with_df(df.drop("__near"))


def previous_row(o: Ordered, cols: Sequence[str], out: str) -> Ordered:
    """Struct of ``cols`` from the row before, null on the group's first row."""
    return _neighbour(o, cols, out, -1)


def next_row(o: Ordered, cols: Sequence[str], out: str) -> Ordered:
    """Struct of ``cols`` from the row after, null on the group's last row."""
    return _neighbour(o, cols, out, 1)


def _fill(o: Ordered, value: Column, out: str, forward: bool, strict: bool) -> Ordered:
    w = o.window()
    if forward:
        frame = w.rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
        inside = F.last(value, ignorenulls=True).over(frame)
    else:
        frame = w.rowsBetween(1 if strict else W.currentRow, W.unboundedFollowing)
        inside = F.first(value, ignorenulls=True).over(frame)
    if not o.sliced:
        return o.with_column(out, inside)
    best = F.max_by if forward else F.min_by
    edges = o.df.groupBy(*o.keys, SLICE).agg(
        best(value, F.when(value.isNotNull(), F.struct(*o.order))).alias("__edge")
    )
    cw = o.carry_window()
    if forward:
        near = F.last("__edge", ignorenulls=True).over(cw.rowsBetween(W.unboundedPreceding, -1))
    else:
        near = F.first("__edge", ignorenulls=True).over(cw.rowsBetween(1, W.unboundedFollowing))
    carry = edges.withColumn("__near", near).drop("__edge")
    df = _join_carry(o.with_column(out, inside), carry)
    df = df.withColumn(out, F.coalesce(F.col(out), F.col("__near")))
    return o.with_df(df.drop("__near"))


def last_known(o: Ordered, value: Column, out: str, strict: bool = False) -> Ordered:
    """Most recent non-null ``value`` at or (``strict``) before this row."""
    return _fill(o, value, out, forward=True, strict=strict)


def next_known(o: Ordered, value: Column, out: str, strict: bool = False) -> Ordered:
    """Nearest non-null ``value`` at or (``strict``) after this row."""
    return _fill(o, value, out, forward=False, strict=strict)
