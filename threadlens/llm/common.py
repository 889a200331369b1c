"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import materialize

CHUNK_CHARS = 1 << 20
BATCH_BYTES = 4 << 20
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = CHUNK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches into slices of about ``chars`` characters; a null text reads as empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < batch.num_rows:
            size = np.cumsum(sizes[begin:] + 1)
            end = begin + min(int(np.searchsorted(size, chars)) + 1, len(size))
            part = batch.slice(begin, end - begin)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            begin = end


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, which may hold very long texts, to be sent to Python in batches bounded by bytes."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def kept_by_worker(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per Python worker, which Spark reuses for many tasks.

    For tables that only save work: a task of a new worker makes its own.  The
    functions of this package reach tasks by value, so their module's variables
    would be new in every task.
    """
    name = "threadlens_worker_state"
    held = vars(sys.modules.setdefault(name, types.ModuleType(name))).setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


class RecentTable:
    """A dict of bounded size: what is not asked for while ``size`` further entries come is forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict = {}
        self.old: dict = {}

    def make_room(self, more: int = 1) -> bool:
        """To be called before ``more`` entries come; true if the newer entries have become the older ones."""
        if len(self.new) + more <= self.size or not self.new:
            return False
        self.old, self.new = self.new, {}
        return True


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` (a written table of narrow rows), marked for broadcast if it has ``rows`` rows at most; else a shuffled join follows."""
    return F.broadcast(small) if small.count() <= rows else small


def share(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``: the fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest node reachable from every node that has an edge: (node, component).

    Alternating large-star and small-star rounds.  Each round joins every edge to
    one minimum per node, so a hub costs its number of edges and no more; the
    edges of a round are written to the shared folder, which cuts the lineage.
    The rounds end when the sum over the edges' hashes no longer changes.
    """
    a, b = F.col(left), F.col(right)
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "edges")
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        now = materialize(small, "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def named_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, name) of every node with an edge; ``nodes`` has (node, least), the name is the smallest ``least``."""
    found = components(edges).join(nodes.select("node", "least"), "node")
    names = found.groupBy("component").agg(F.min("least").alias("name"))
    return found.join(names, "component").select("node", "name")
