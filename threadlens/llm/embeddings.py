"""Embedding near-duplicates by collision-counting projections.

Every vector is projected on many random lines, the lists.  Two vectors collide
in a list if their projections lie within a window centred at either of them.
Near vectors collide in many lists and far ones in few, so a pair whose number
of collisions reaches a calibrated count is verified by its exact cosine.

A window on one line holds a fixed share of all vectors however many lists there
are, so each list is cut into segments by the signs of a few more projections;
a collision needs the same segment as well.  From the probability that two
vectors at the threshold collide in one list, the number of lists and the count
are set so that such a pair passes with probability ``recall`` at least.

A vector goes to its segment of every list.  There the rows are sorted by their
projection and each row's window is scanned.  The collisions of a pair in all
lists follow from the two vectors themselves, so a pair is counted and verified
once, in the first list in which it collides, and pairs are never shuffled: a
task returns sums and one edge per row.  Oversized segments are cut into pairs
of slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

from .common import named_components
from .simhash import union

SEGMENT_ROWS = 64
MAX_GROUP = 4096
PAIRS = 1 << 17
RECALL = 0.999
SEED = 11


class Plan(NamedTuple):
    lists: int
    signs: int
    window: float
    need: int
    threshold: float


def at_least(n: int, p: float, k: int) -> float:
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def calibrate(n: int, threshold: float, recall: float = RECALL) -> Plan:
    """Lists, signs per list, window and count for ``n`` vectors."""
    signs = max(2, math.ceil(math.log2(max(2, n) / SEGMENT_ROWS)))
    apart = math.sqrt(2 - 2 * threshold)
    hit = (1 - math.acos(threshold) / math.pi) ** signs * math.erf(2 / math.sqrt(2))
    lists = 2
    while at_least(lists, hit, 2) < recall:
        lists += 1
    need = 2
    while at_least(lists, hit, need + 1) >= recall:
        need += 1
    return Plan(lists, signs, 2 * apart, need, threshold)


class Projections:
    """Segments and projections of unit vectors in every list."""

    def __init__(self, plan: Plan, dim: int):
        rng = np.random.default_rng([SEED, dim])
        self.plan = plan
        self.lines = rng.standard_normal((dim, plan.lists * (plan.signs + 1)))

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, signs = self.plan.lists, self.plan.signs
        values = (unit @ self.lines).reshape(len(unit), lists, signs + 1)
        segment = (values[:, :, :signs] > 0) @ (np.int64(1) << np.arange(signs, dtype=np.int64))
        return segment, values[:, :, signs]


def unit_rows(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of unit length in double precision."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def with_segments(vectors: DataFrame, plan: Plan) -> DataFrame:
    """``vectors`` (node, n, dim, embedding), one row per list with (list, segment)."""

    def placed(batches):
        made: dict = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in made:
                    made[dim] = Projections(plan, dim)
                segment, _ = made[dim](unit_rows(part.column("embedding")))
                lists = pa.ListArray.from_arrays(np.arange(len(segment) + 1) * plan.lists, segment.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "segments"])

    kind = dict(vectors.dtypes)["embedding"]
    made = vectors.mapInArrow(placed, f"node long, n long, dim int, embedding {kind}, segments array<long>")
    return made.select("node", "n", "dim", "embedding", F.posexplode("segments").alias("list", "segment"))


def cells(rows: DataFrame, max_group: int) -> DataFrame:
    """Adds (low, high, slice): a group beyond the bound is compared slice by slice, every pair of slices in a group of its own."""
    key = ["dim", "list", "segment"]
    big = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max_group), "large-segments")
    if big.isEmpty():
        return rows.select("*", *(F.lit(0).alias(c) for c in ("low", "high", "slice")))
    slices = F.ceil(F.col("size") / (max_group / 2)).cast("int")
    return (
        rows.join(big, key, "left").withColumn("slices", F.coalesce(slices, F.lit(1)))
        .withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other"))
        .drop("size", "slices", "other")
    )


def windows(order: np.ndarray, value: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose values differ by ``width`` at most, in bounded pieces."""
    sorted_value = value[order]
    reach = np.searchsorted(sorted_value, sorted_value + width, "right") - np.arange(len(order)) - 1
    begin = 0
    while begin < len(order):
        end = begin + max(1, int(np.searchsorted(np.cumsum(reach[begin:]), PAIRS, "right")))
        times = reach[begin:end]
        a = np.repeat(np.arange(begin, begin + len(times)), times)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        yield order[a], order[b]
        begin = end


def group_links(unit, n, slices, apart: bool, at: int, project: Projections):
    """(links, label) of one group: weighted link counts and joined sets of its rows."""
    plan = project.plan
    segment, value = project(unit)
    links, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
    for a, b in windows(np.argsort(value[:, at], kind="stable"), value[:, at], plan.window):
        if apart:
            across = slices[a] != slices[b]
            a, b = a[across], b[across]
        hit = (segment[a] == segment[b]) & (np.abs(value[a] - value[b]) <= plan.window)
        passed = (hit.sum(1) >= plan.need) & (hit.argmax(1) == at)
        a, b = a[passed], b[passed]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= plan.threshold
        a, b = a[near], b[near]
        links += np.bincount(a, n[b], len(unit)).astype(np.int64) + np.bincount(b, n[a], len(unit)).astype(np.int64)
        label = union(label, a, b)
    return links, label


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """One table per run of rows with equal keys, across batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in key], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[start].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_vectors(
    rows: DataFrame, threshold: float = 0.95, id: str = "vec_id", vector: str = "embedding", max_group: int = MAX_GROUP
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing; vectors of different length don't link.  Equal vectors are
    collapsed first and counted with their number.  A row with a null id never
    names a component.
    """
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    source = rows.select(F.col(id).alias("id"), F.col(vector).alias("v")).withColumn("valid", F.coalesce(whole, F.lit(False)))
    hashed = source.select("id", "valid", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(SEED), "v").alias("g"))
    narrow = hashed.select("id", "valid", "h", "g")
    distinct = hashed.where("valid").groupBy("h", "g").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("embedding")
    )
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    plan = calibrate(distinct.count(), threshold)
    placed = cells(with_segments(distinct.select("node", "n", F.size("embedding").alias("dim"), "embedding"), plan), max_group)
    key = ["dim", "list", "segment", "low", "high"]

    def linked(batches):
        project: dict = {}
        for group in whole_groups(batches, key):
            if group.num_rows < 2:
                continue
            dim, at = group.column("dim")[0].as_py(), group.column("list")[0].as_py()
            if dim not in project:
                project[dim] = Projections(plan, dim)
            unit = unit_rows(group.column("embedding").combine_chunks())
            apart = group.column("low")[0].as_py() != group.column("high")[0].as_py()
            links, label = group_links(
                unit, group.column("n").to_numpy(), group.column("slice").to_numpy(), apart, at, project[dim]
            )
            found = np.flatnonzero(links)
            if len(found):
                node = group.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[found]), pa.array(links[found]), pa.array(node[label[found]])], ["node", "links", "root"]
                )

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        placed.repartition(n, *key).sortWithinPartitions(*key)
        .select(*key, "slice", "node", "n", "embedding").mapInArrow(linked, "node long, links long, root long")
    )
    found = materialize(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = named_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), distinct)
    classes = (
        distinct.select("h", "g", "node", "n", "least").join(counts, "node", "left").join(names, "node", "left")
        .select("h", "g", F.lit(True).alias("valid"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("name", "least").alias("component_id"))
    )
    return narrow.join(classes, ["h", "g", "valid"], "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)))
