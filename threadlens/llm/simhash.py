"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: a bit is 1 if it is set in over half of the hashes of a text's
word shingles, repeats included.

Links: two fingerprints within ``radius`` differing bits agree on one of
``radius + 1`` blocks of bits, so each is sent to one group per block, keyed by
the block's value.  Inside a task the rows lie in the order of their Gray rank,
where neighbours differ in few bits.  Runs of rows form the nodes of a
hierarchy: a node holds the bit pattern that all rows below it share, under a
mask, and each level keeps only the bits that its parent does not already hold.
A search goes down from the top, adds the differences on each node's own bits to
those of its parents, and leaves a whole group as soon as the sum exceeds the
radius.  Groups with more than ``MAX_GROUP`` distinct fingerprints are cut by the
same rule on the bits that are still free, so no group grows with the data and
no pair is lost.  A task joins what it links and passes on one edge per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import materialize

from .common import BROADCAST_ROWS, bounded, components, named_components, small_batches, text_chunks

SEED = 42
FAN = 16
MAX_GROUP = 8192
OPEN_GROUP = 2048
SHORT = 16
TASK_ROWS = 1 << 16
LANE_ROWS = 60_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words; A-Z lower-cased, words split at ASCII white space.

    A text with fewer words gives one hash of all of them, a text without words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = (ends - np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))[: len(words) - size + 1]
    runs = map(joined.__getitem__, map(slice, starts.tolist(), (ends[size - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per text from the concatenated hashes; ``sizes`` are the hashes of each text.

    Four bits are counted at once in lanes of 16 bits, over runs that cannot overflow a lane.
    """
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    filled = np.flatnonzero(sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    runs = [np.arange(begin[i], begin[i + 1], LANE_ROWS) for i in filled]
    owner = np.repeat(np.arange(len(filled)), [len(r) for r in runs])
    first = np.concatenate(runs)
    head = np.searchsorted(owner, np.arange(len(filled)))
    lanes = np.uint64(0x0001000100010001)
    for k in range(16):
        counts = np.add.reduceat((hashes >> np.uint64(k)) & lanes, first)
        for lane in range(4):
            ones = np.add.reduceat((counts >> np.uint64(16 * lane)) & np.uint64(0xFFFF), head)
            on = 2 * ones.astype(np.int64) > sizes[filled]
            out[filled] |= on.astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` without its texts, with a 64-bit fingerprint (as a signed integer) in ``out``.

    Null texts count as empty; a text without words has fingerprint 0.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in rest]

    def made(batches):
        for batch, texts in text_chunks(batches, text):
            hashes = [shingle_hashes(t, size) for t in texts]
            fp = majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(fp.view(np.int64))], names=[*names, out]
            )

    return small_batches(docs.select(*names, text)).mapInArrow(made, T.StructType([*rest, T.StructField(out, T.LongType())]))


# ------------------------------------------------------------------- the index


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each word in the sequence in which neighbours differ by one bit."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(bits: Column) -> Column:
    return reduce(lambda x, s: x.bitwiseXOR(F.shiftrightunsigned(x, s)), (1, 2, 4, 8, 16, 32), bits)


class GrayIndex:
    """Hierarchy over words in Gray order; ``levels`` run from the top to the rows themselves."""

    def __init__(self, bits: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        pattern, mask = bits, np.full(len(bits), full, np.uint64)
        levels = [(pattern, mask)]
        while len(pattern) > FAN:
            at = np.arange(0, len(pattern), FAN)
            ones, any_one = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(ones ^ any_one)
            pattern = ones
            levels.append((pattern, mask))
        levels.reverse()
        self.levels = []
        for depth, (pattern, mask) in enumerate(levels):
            own = mask
            if depth:
                own = mask & ~np.repeat(levels[depth - 1][1], FAN)[: len(mask)]
            self.levels.append((pattern, own))
        self.bits = bits

    def pairs(self, radius: int, exact: np.uint64, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j within the radius that agree on all bits of ``exact``."""
        n, depth = len(self.bits), len(self.levels)
        for begin in range(0, n, rows):
            end = min(n, begin + rows)
            top = len(self.levels[0][0])
            query = np.repeat(np.arange(begin, end), top)
            node = np.tile(np.arange(top), end - begin)
            far = np.zeros(len(query), np.uint8)
            for level, (pattern, own) in enumerate(self.levels):
                span = FAN ** (depth - 1 - level)
                later = (node + 1) * span - 1 > query if span > 1 else node > query
                query, node, far = query[later], node[later], far[later]
                differ = (self.bits[query] ^ pattern[node]) & own[node]
                far = far + np.bitwise_count(differ)
                near = (far <= radius) & ((differ & exact) == 0)
                query, node, far = query[near], node[near], far[near]
                if level < depth - 1:
                    below = len(self.levels[level + 1][0])
                    query, far = np.repeat(query, FAN), np.repeat(far, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < below
                    query, node, far = query[there], node[there], far[there]
            yield query, node


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each set after joining the sets of every pair (a, b)."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above


def key_bits(width: int, radius: int) -> list[int]:
    """Bits that are fixed at each level: a key of 1/(radius+1) of the free bits is added per level."""
    fixed, out = 0, []
    while width - fixed > 13 or not out:
        step = (width - fixed) // (radius + 1)
        if not step:
            break
        fixed += step
        out.append(fixed)
    return out


def _turn(bits: Column, width: int, fixed: int, by: int) -> Column:
    """Turn the ``width - fixed`` low bits left by ``by``; the fixed bits above them stay."""
    free = width - fixed
    if by == 0:
        return bits
    low_mask = (1 << free) - 1
    low = bits.bitwiseAND(F.lit(low_mask if free < 64 else -1))
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, free - by)).bitwiseAND(
        F.lit(low_mask if free < 64 else -1)
    )
    return turned if free == 64 else turned.bitwiseOR(bits.bitwiseAND(F.lit(~low_mask)))


def keyed(rows: DataFrame, width: int, radius: int, max_group: int = MAX_GROUP) -> DataFrame:
    """Rows (path, turned, ...) with (key, fixed) added, one per block, groups within the bound.

    ``path`` tells rows apart that must never meet.  Oversized groups are cut
    again on their free bits; after the last cut a group has 2**13 words or so
    at most if its rows are distinct words, as they share all other bits.  Rows
    of equal words are left to ``sliced``.
    """
    cuts = key_bits(width, radius)
    done, fixed = [], 0
    for depth, now in enumerate(cuts):
        turns = F.array(*(
            F.struct(F.lit(i).alias("i"), _turn(F.col("turned"), width, fixed, i * ((width - fixed) // (radius + 1))).alias("turned"))
            for i in range(radius + 1)
        ))
        rows = (
            rows.withColumn("block", F.explode(turns))
            .withColumn("path", F.concat_ws("/", "path", F.col("block.i").cast("string")))
            .withColumn("turned", F.col("block.turned")).drop("block")
            .withColumn("key", F.shiftrightunsigned("turned", width - now))
            .withColumn("fixed", F.lit(now))
        )
        fixed = now
        if depth == len(cuts) - 1:
            done.append(rows)
            break
        big = rows.groupBy("path", "key").count().where(F.col("count") > max_group).select("path", "key", F.lit(True).alias("big"))
        big = materialize(big, "large-groups")
        if big.isEmpty():
            done.append(rows)
            break
        marked = rows.join(big, ["path", "key"], "left")
        done.append(marked.where("big IS NULL").drop("big"))
        rows = marked.where("big").drop("big", "key", "fixed")
    return reduce(DataFrame.unionByName, done)


def sorted_groups(rows: DataFrame) -> DataFrame:
    """Groups whole inside partitions, in Gray order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.withColumn("rank", gray_rank_column(F.col("turned")))
        .repartition(n, "path", "key").sortWithinPartitions("path", "key", "rank").drop("rank")
    )


def grouped_batches(batches: Iterator[pa.RecordBatch], rows: int = TASK_ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole groups of one path."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path = np.asarray(batch.column("path").to_pylist(), object)
        key = batch.column("key").to_numpy()
        new = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        turn = set((np.flatnonzero(path[1:] != path[:-1]) + 1).tolist())
        last = held[-1].slice(held[-1].num_rows - 1).to_pylist()[0] if held else None
        cuts = new.tolist()
        if last is not None and (last["path"], last["key"]) != (path[0], int(key[0])):
            cuts.insert(0, 0)
            if last["path"] != path[0]:
                turn.add(0)
        start = 0
        for cut in cuts:
            if size + cut - start >= rows or cut in turn:
                if cut > start:
                    held.append(batch.slice(start, cut - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, start = [], 0, cut
        held.append(batch.slice(start))
        size += batch.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, radius: int, width: int = 64, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints ``fp`` within the radius, transitively.

    Every link inside a task is found; of those, the edges of a star per joined
    set are returned, which give the same components.
    """
    rows = keyed(distinct.select(F.lit("").alias("path"), F.col("fp").alias("turned"), "fp"), width, radius, max_group)

    def joined(batches):
        for table in grouped_batches(batches):
            bits = table.column("turned").to_numpy().view(np.uint64)
            fixed = table.column("fixed")[0].as_py()
            exact = np.uint64(((1 << fixed) - 1) << (width - fixed))
            label = np.arange(len(bits))
            for i, j in GrayIndex(bits).pairs(radius, exact):
                label = union(label, i, j)
            moved = np.flatnonzero(label != np.arange(len(bits)))
            fp = table.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    return sorted_groups(rows).select("path", "key", "fixed", "turned", "fp").mapInArrow(joined, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest
    id that can be reached over links of at most ``radius`` differing bits, the
    row's own id included.  Rows with a null id take part but never name a
    component; a component of such rows alone has a null id.  Repeated rows are
    returned as often as they occur.
    """
    made = materialize(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), size=size), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    named = named_components(links(distinct, radius), distinct.withColumnRenamed("fp", "node")).withColumnRenamed("node", "fp")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    return made.join(classes, "fp").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---------------------------------------- duplicates by similarity of their texts


def differing(shared: int, left: int, right: int) -> float:
    """Probability that a bit differs between a set of ``shared + left`` hashes and one of ``shared + right``; ties give 0."""
    def ones(n):
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def on(own):
        return np.array([ones(own)[2 * (s + np.arange(own + 1)) > shared + own].sum() for s in range(shared + 1)])

    x, y = on(left), on(right)
    return float((ones(shared) * (x * (1 - y) + y * (1 - x))).sum())


@cache
def most_differing(similarity: float) -> float:
    """Probability that a bit differs at the similarity, for the sizes above ``SHORT`` where it is largest.

    Large sets have a cosine of about 2s/(1+s), and their bits differ with
    probability acos(cosine)/pi.  Small ones differ more often, since a bit that
    is set in just half of an even number of hashes counts as 0; the excess
    shrinks with the size, so sizes up to twice ``SHORT`` are looked at.
    """
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for n in range(SHORT + 1, 2 * SHORT + 1):
        for m in range(n, int(n / similarity + 1e-9) + 1):
            shared = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if shared <= n:
                most = max(most, differing(shared, n - shared, m - shared))
    return most


def word_plan(n: int, similarity: float, radius: int = 2, recall: float = 0.99) -> tuple[int, int]:
    """(bits, count) of the short words cut from a long fingerprint for ``n`` texts.

    The words are long enough that a text meets few chance neighbours, and as
    many as it takes for one of them to be within the radius with the asked
    probability, for texts of more than ``SHORT`` shingles.
    """
    bits = min(60, max(20, math.ceil(math.log2(max(2, n))) + 6))
    differ = most_differing(similarity)
    hit = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(radius + 1))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def long_fingerprints(hashes: np.ndarray, sizes: np.ndarray, blocks: int) -> np.ndarray:
    """``blocks`` independent 64-bit fingerprints per text, from as many scramblings of its shingle hashes."""
    out = np.empty((len(sizes), blocks), np.uint64)
    for block in range(blocks):
        with np.errstate(over="ignore"):
            salted = hashes ^ np.uint64((block * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            salted = salted * np.uint64(0xD6E8FEB86659FD93)
            salted ^= salted >> np.uint64(32)
            salted *= np.uint64(0xD6E8FEB86659FD93)
            salted ^= salted >> np.uint64(29)
        out[:, block] = majority_bits(salted, sizes)
    return out


def short_word(blocks: Column, at: Column, bits: int) -> Column:
    """Word number ``at`` of ``bits`` bits; a 64-bit block holds as many whole words as fit."""
    per = 64 // bits
    block = F.element_at(blocks, (F.floor(at / per) + 1).cast("int"))
    moved = [F.shiftrightunsigned(block, k * bits) for k in range(per)]
    return F.element_at(F.array(*moved), (at % per + 1).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))


def forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the pairs that form a spanning forest of the nearest pairs (rounds of cheapest edges)."""
    label, chosen = np.arange(n), []
    weight = (far.astype(np.int64) << 32) | np.arange(len(a))
    none = np.iinfo(np.int64).max
    at = np.arange(len(a))
    while True:
        x, y = label[a[at]], label[b[at]]
        at = at[x != y]
        if not len(at):
            return np.unique(np.concatenate(chosen)) if chosen else at
        best = np.full(n, none)
        np.minimum.at(best, label[a[at]], weight[at])
        np.minimum.at(best, label[b[at]], weight[at])
        edges = np.unique(best[best < none]) & 0xFFFFFFFF
        chosen.append(edges)
        label = union(label, a[edges], b[edges])


def near_forest(bits: np.ndarray, prints: np.ndarray, radius: int, exact: np.uint64, farthest: int):
    """Forest edges (i, j) of the pairs that meet in the index and whose long fingerprints are within ``farthest``."""
    a = b = np.empty(0, np.int64)
    far = np.empty(0, np.int64)
    for i, j in GrayIndex(bits).pairs(radius, exact, 256):
        d = np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64)
        near = d <= farthest
        if near.any():
            a, b, far = np.concatenate([a, i[near]]), np.concatenate([b, j[near]]), np.concatenate([far, d[near]])
            at = forest(len(bits), a, b, far)
            a, b, far = a[at], b[at], far[at]
    return a, b


def similar_texts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 2,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """(id, text_hash, component) for every row: component is the smallest text hash of its class.

    Distinct texts meet in the index if a short word of their long fingerprints
    is within the radius.  Of those whose whole fingerprints are close enough,
    each task keeps a spanning forest of the nearest pairs, and every forest edge
    is verified by the exact Jaccard similarity of the two shingle sets.  Where
    that leaves a tree in several classes, all its close pairs between different
    classes are verified too.  Pairs with a text of ``SHORT`` shingles or fewer
    are found exactly (``short_links``).  Null and empty texts are copies of one
    another.
    """
    bits, count = word_plan(docs.count(), similarity, radius)
    differ = most_differing(similarity)
    shortest = int(SHORT / similarity + 1e-9)
    blocks = -(-count // (64 // bits))
    farthest = int(64 * blocks * differ + 3 * math.sqrt(64 * blocks * differ * (1 - differ)))

    def made(batches):
        for batch, texts in text_chunks(batches, "text"):
            hashes = [np.unique(shingle_hashes(t, size)) for t in texts]
            prints = long_fingerprints(np.concatenate(hashes), np.array([len(h) for h in hashes]), blocks)
            lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1) * blocks, prints.ravel().view(np.int64))
            n = pa.array([len(h) for h in hashes], pa.int32())
            few = pa.array([h.view(np.int64) if len(h) <= shortest else None for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), lists, n, few], ["id", "text_hash", "blocks", "n", "few"]
            )

    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        source.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("blocks", longs),
        T.StructField("n", T.IntegerType()), T.StructField("few", longs),
    ])
    rows = materialize(small_batches(source).mapInArrow(made, schema), "long-fingerprints")
    distinct = rows.groupBy("text_hash").agg(*(F.any_value(c).alias(c) for c in ("blocks", "n", "few")))
    distinct = materialize(distinct, "distinct-texts")
    few = distinct.where("few IS NOT NULL").select("text_hash", F.col("few").alias("shingles"))
    numbers = F.sequence(F.lit(0), F.lit(count - 1))
    cut = distinct.where(F.col("n") > SHORT).select("text_hash", "blocks", F.explode(numbers).alias("at")).select(
        F.col("at").cast("string").alias("path"), short_word(F.col("blocks"), F.col("at"), bits).alias("turned"), "text_hash", "blocks"
    )
    groups = sliced(keyed(cut, bits, radius, max_group), max_group)

    def near(batches):
        for table in grouped_batches(batches, 1 << 14):
            turned = table.column("turned").to_numpy().view(np.uint64)
            prints = table.column("blocks").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, blocks)
            fixed = table.column("fixed")[0].as_py()
            exact = np.uint64(((1 << fixed) - 1) << (bits - fixed))
            a, b = near_forest(turned, prints, radius, exact, farthest)
            hashes = table.column("text_hash").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(hashes[a]), pa.array(hashes[b])], ["a", "b"])

    edges = (
        sorted_groups(groups).select("path", "key", "fixed", "turned", "text_hash", "blocks")
        .mapInArrow(near, "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    edges = materialize(edges, "near-texts")
    sets = shingle_sets(edges, source, size)
    classes = materialize(components(verified(edges, sets, similarity).union(short_links(few, similarity))), "text-classes")
    more = across_classes(edges, classes, distinct, sets, similarity, farthest)
    joined = merged_classes(classes, more)
    return rows.select("id", "text_hash").join(joined.withColumnRenamed("node", "text_hash"), "text_hash", "left").select(
        "id", "text_hash", F.coalesce("component", "text_hash").alias("component")
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sliced(groups: DataFrame, max_group: int) -> DataFrame:
    """Cut oversized groups, each pair of slices going into a group of its own, so every two rows still meet.

    Rows are distinct texts, of which any number may share a word.
    """
    big = groups.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group)
    big = materialize(big, "large-slices")
    if big.isEmpty():
        return groups
    slices = F.ceil(F.col("n") / (max_group / 2)).cast("int")
    return (
        groups.join(big, ["path", "key"], "left").withColumn("slices", F.coalesce(slices, F.lit(1)))
        .withColumn("slice", F.pmod(F.xxhash64("text_hash"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("path", F.when(F.col("slices") == 1, F.col("path")).otherwise(
            F.concat_ws("#", "path", F.least("slice", "other").cast("string"), F.greatest("slice", "other").cast("string"))
        ))
        .drop("n", "slices", "slice", "other")
    )


def shingle_sets(edges: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """(text_hash, shingles) of every end of an edge; sorted distinct hashes."""
    ends = materialize(edges.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct(), "near-ends")

    def sets(batches):
        for batch, texts in text_chunks(batches, "text"):
            lists = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_hash"), pa.array(lists, pa.list_(pa.int64()))], ["text_hash", "shingles"]
            )

    held = (
        small_batches(source.join(bounded(ends, BROADCAST_ROWS), "text_hash").select("text_hash", "text"))
        .mapInArrow(sets, "text_hash long, shingles array<long>")
        .groupBy("text_hash").agg(F.any_value("shingles").alias("shingles"))
    )
    return materialize(held, "shingle-sets")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges between text hashes whose shingle sets have at least the Jaccard similarity."""
    both = F.size(F.array_intersect("x", "y"))
    return (
        edges.join(sets.select(F.col("text_hash").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("text_hash").alias("b"), F.col("shingles").alias("y")), "b")
        .where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")
    )


def set_links(sets: pa.ListArray, label: np.ndarray, similarity: float, near=None) -> Iterator[tuple[int, int]]:
    """Pairs i < j of sets that have at least the Jaccard similarity and join all labels that such pairs join.

    A pair whose labels are joined already is not looked at; ``near(i, j)`` tells which of the rows j may be near.
    """
    label = label.copy()
    codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    end = sets.offsets.to_numpy().astype(np.int64) - sets.offsets[0].as_py()
    start, size = end[:-1], np.diff(end)
    held = np.zeros(len(codes) + 1, bool)
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])]
        if near is not None and len(j):
            j = j[near(i, j)]
        if not len(j):
            continue
        own = codes[start[i] : end[i + 1]]
        held[own] = True
        both = np.fromiter((np.count_nonzero(held[codes[start[k] : end[k + 1]]]) for k in j), np.int64, len(j))
        held[own] = False
        j = j[both >= similarity * (size[i] + size[j] - both)]
        for k in j.tolist():
            if label[k] != label[i]:
                yield i, k
                label[label == label[k]] = label[i]


def short_links(few: DataFrame, similarity: float, max_group: int = OPEN_GROUP) -> DataFrame:
    """Edges (a, b) that join all texts of ``few`` (text_hash, shingles) with at least the Jaccard similarity.

    In an order of all shingles, two such sets of n and m share one of the first
    n - ceil(s n) + 1 and m - ceil(s m) + 1; the rarest come first.  Sets without
    a shingle have one key of their own.
    """
    each = few.select("text_hash", F.explode("shingles").alias("key"))
    ranked = each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    ranked = ranked.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("rows", "key"))).alias("order"))
    n = F.size("order")
    first = F.slice("order", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))
    keys = ranked.select("text_hash", F.explode(first).alias("at")).select("text_hash", F.lit("").alias("path"), F.col("at.key").alias("key"))
    none = few.where(F.size("shingles") == 0).select("text_hash", F.lit("none").alias("path"), F.lit(0).cast("long").alias("key"))
    groups = sliced(materialize(keys.union(none).join(few, "text_hash"), "short-texts"), max_group)

    def linked(batches):
        for group in same_key(grouped_batches(batches, max_group)):
            hashes = group.column("text_hash").to_numpy()
            pairs = list(set_links(group.column("shingles").combine_chunks(), np.arange(len(hashes)), similarity))
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(hashes[a]), pa.array(hashes[b])], ["a", "b"])

    parts = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        groups.repartition(parts, "path", "key").sortWithinPartitions("path", "key")
        .select("path", "key", "text_hash", "shingles").mapInArrow(linked, "a long, b long")
    )


def across_classes(
    edges: DataFrame, classes: DataFrame, distinct: DataFrame, sets: DataFrame, similarity: float, farthest: int,
    max_group: int = OPEN_GROUP,
) -> DataFrame:
    """Edges (a, b) between classes of ``classes`` (node, component) that near texts of both join.

    A forest keeps no pair that its other edges connect, so a pair may have been
    left out for edges that then failed.  The two texts lie in one tree of all
    forest edges.  A tree whose texts are one class needs nothing more; of any
    other, every pair of texts of different classes whose whole fingerprints are
    within ``farthest`` is verified, wherever a word of theirs met.
    """
    trees = components(edges).select(F.col("node").alias("text_hash"), F.col("component").alias("key"))
    trees = trees.join(classes.withColumnRenamed("node", "text_hash"), "text_hash", "left").select(
        "key", "text_hash", F.coalesce("component", "text_hash").alias("class")
    )
    trees = materialize(trees, "text-trees")
    torn = trees.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    torn = materialize(torn, "open-trees")
    rows = trees.join(torn, "key").join(distinct.select("text_hash", "blocks"), "text_hash").join(sets, "text_hash").withColumn("path", F.lit(""))
    groups = sliced(rows, max_group)

    def linked(batches):
        for group in same_key(grouped_batches(batches, max_group)):
            prints = group.column("blocks").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(group.num_rows, -1)
            kind = group.column("class").to_numpy()

            def near(i, j, prints=prints):
                return np.bitwise_count(prints[j] ^ prints[i]).sum(1, dtype=np.int64) <= farthest

            pairs = list(set_links(group.column("shingles").combine_chunks(), kind, similarity, near))
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(kind[a]), pa.array(kind[b])], ["a", "b"])

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        small_batches(groups.repartition(n, "path", "key").sortWithinPartitions("path", "key"))
        .select("path", "key", "text_hash", "class", "blocks", "shingles").mapInArrow(linked, "a long, b long")
    )


def same_key(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The groups of equal keys in tables sorted by key, those of one row left out."""
    for table in tables:
        key = table.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end - start > 1:
                yield table.slice(start, end - start)


def merged_classes(classes: DataFrame, more: DataFrame) -> DataFrame:
    """``classes`` (node, component) after joining classes, which texts without one are of their own, by the edges ``more``."""
    found = materialize(components(more), "joined-classes").select(F.col("node").alias("component"), F.col("component").alias("least"))
    named = classes.join(found, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    alone = found.join(classes.select("component").distinct(), "component", "left_anti")
    return named.union(alone.select(F.col("component").alias("node"), F.col("least").alias("component")))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near-duplicates the row with the smallest id.

    Of rows that repeat with the same id and text, one stays.  A class whose ids
    are all null keeps one row.
    """
    classes = similar_texts(docs, id, text, size, similarity)
    rows = classes.groupBy("component", "id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("best"))
    kept = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.text_hash") == F.col("text_hash"))
    marked = materialize(
        rows.join(best, "component").withColumn("kept", kept).select("id", "text_hash", "copies", "kept"), "classes"
    )
    out = docs.withColumn("__hash", text_hash(F.col(text)))
    names = docs.columns

    def meets(side: DataFrame):
        side = side.select(F.col("id").alias("__id"), F.col("text_hash").alias("__text_hash"))
        return side, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text_hash"))

    gone, on = meets(materialize(marked.where("NOT kept"), "dropped"))
    out = out.join(bounded(gone, BROADCAST_ROWS), on, "left_anti")
    again = materialize(marked.where("kept AND copies > 1"), "repeated")
    if again.isEmpty():
        return out.select(*names)
    again, on = meets(again)
    again = bounded(again, BROADCAST_ROWS)
    return out.join(again, on, "left_anti").select(*names).unionByName(
        out.join(again, on, "left_semi").dropDuplicates([id, "__hash"]).select(*names)
    )
