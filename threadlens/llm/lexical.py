"""Ranked lexical search by norm buckets of impact vectors.

A document is a vector over the queries' terms, with its impact on each, and a
query a vector of its terms' counts times their weights; the score is their
product.  With the weights on its side, a query's length lies in few coordinates.

The vectors are ordered by length over the whole table and cut into buckets.  A
few rounds, each a larger share of the buckets than the last, search them in that
order, and the scores found so far give every query a bound from below for its
k-th best.  Cauchy-Schwarz leaves out a bucket whose longest vector, times the
query, is below the bound (for all queries at once it's a filter of the scan).
Inside a bucket a query's heaviest coordinates, which hold nearly all of its
length, are looked up in lists: a document must reach the bound with what it has
there and, by Cauchy-Schwarz, at most the product of what is left of both lengths.  Survivors are scored in 64-bit
integers.  Bounds are in doubles with a margin far above their rounding, so no
document that belongs in a list is left out, ties included.

Texts are read once for all queries of a block; queries come in blocks of a
bounded number of terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import materialize

from .common import small_batches
from .words import BASE, INVERSE, mix

TOP = 20
BLOCK_TERMS = 1_000_000
CHUNK_BYTES = 1 << 20
#: Shares of the buckets, longest vectors first, that the rounds have searched at their ends.
ROUNDS = (0.02, 0.2, 1.0)
FIRST_BUCKET, LARGEST_BUCKET = 128, 4096
FOCUS = 31 / 32  # share of a query's squared length
MARGIN = 1e-9


# ----------------------------------------------------------------------- terms


def byte_table() -> np.ndarray:
    """Every byte as it stands in a term: A-Z in lower case, 0 for what separates terms.

    All bytes of a character beyond ASCII belong to terms, so UTF-8 needs no decoding.
    """
    table = np.arange(256, dtype=np.uint8)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[low : high + 1] = 0
    table[65:91] += 32
    return table


BYTES = byte_table()


class Terms(NamedTuple):
    """Term i is ``data[start[i]:end[i]]``, of text ``doc[i]``, with hash ``hash[i]``."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Splitter:
    """Terms of the texts of a string array; keeps its tables of powers."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, texts: pa.StringArray) -> Terms:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
        # A separator goes behind every text, so no term crosses texts.
        ends = (offsets[1:] - offsets[0]) + np.arange(len(texts))
        data = np.zeros(len(raw) + len(texts), np.uint8)
        inside = np.ones(len(data), bool)
        inside[ends] = False
        data[inside] = BYTES[raw]
        if len(self.up) <= len(data):
            size = max(len(data) + 1, 1 << 21)
            self.up, self.down = powers_of(BASE, size), powers_of(INVERSE, size)
        step = np.diff((data > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        return Terms(data, np.searchsorted(ends, start), start, end, mix((sums[end] - sums[start]) * self.down[start]))


def chunks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHUNK_BYTES`` of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False) + 1)
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Vocabulary:
    """Numbers of the queries' terms."""

    def __init__(self, terms: list[bytes]):
        one = Splitter()(pa.array([t.decode() for t in terms], pa.string()))
        order = np.argsort(one.hash, kind="stable")
        self.hash = one.hash[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two query terms have the same 64-bit hash")
        self.number = order
        self.data, self.start, self.length = one.data, one.start, one.end - one.start
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.hash >> np.uint64(42)] = True

    def of(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``terms``, number) of every term that is in the vocabulary, compared byte by byte."""
        may = np.flatnonzero(self.filter[terms.hash >> np.uint64(42)])
        if not len(may) or not len(self.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, terms.hash[may]), len(self.hash) - 1)
        same = self.hash[at] == terms.hash[may]
        place, number = may[same], self.number[at[same]]
        length = terms.end[place] - terms.start[place]
        same = length == self.length[number]
        place, number, length = place[same], number[same], length[same]
        if len(place):
            first = np.cumsum(length) - length
            along = np.arange(int(length.sum())) - np.repeat(first, length)
            equal = terms.data[np.repeat(terms.start[place], length) + along] == self.data[np.repeat(self.start[number], length) + along]
            whole = np.logical_and.reduceat(equal, first)
            place, number = place[whole], number[whole]
        return place, number


# --------------------------------------------------------------------- queries


class Queries(NamedTuple):
    """A block of queries: the key of each, and (query, term, times) triples in the order of query and term."""

    keys: list[int]
    terms: list[bytes]
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray


def asked_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of the terms of every item; an item without one has no row."""

    def made(batches):
        split = Splitter()
        for batch in chunks(batches, "text"):
            t = split(batch.column("text"))
            spans = [t.data[a:b].tobytes() for a, b in zip(t.start.tolist(), t.end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(t.doc)), pa.array(spans, pa.binary())], ["item", "term"])

    return small_batches(items.select("item", "text")).mapInArrow(made, "item long, term binary").groupBy("item", "term").agg(
        F.count(F.lit(1)).alias("times")
    )


def blocks_of(asked: DataFrame, block_terms: int) -> Iterator[Queries]:
    """Blocks of whole queries with about ``block_terms`` terms each; one is held at a time."""
    rows = asked.count()
    blocks = -(-rows // block_terms)
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)).toArrow()
        if not part.num_rows:
            continue
        keys, query = np.unique(part.column("item").to_numpy(), return_inverse=True)
        coded = part.column("term").combine_chunks().dictionary_encode()
        term, times = coded.indices.to_numpy().astype(np.int64), part.column("times").to_numpy()
        order = np.lexsort((term, query))
        yield Queries(keys.tolist(), coded.dictionary.to_pylist(), query[order], term[order], times[order])


# --------------------------------------------------------------------- vectors


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms counted, those of the vocabulary listed."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches):
        vocabulary, split = Vocabulary(sent.value), Splitter()
        for batch in chunks(batches, "text"):
            t = split(batch.column("text"))
            n = np.bincount(t.doc, minlength=batch.num_rows)
            place, number = vocabulary.of(t)
            pair, tf = np.unique(t.doc[place] * len(sent.value) + number, return_counts=True)
            lists = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(sent.value)).astype(np.int32)
            have = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(lists, pa.array(pair % len(sent.value), pa.int32())),
                 pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            ).take(have)

    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).mapInArrow(scan, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Weights(NamedTuple):
    """Integer weight of every term of the block, number of documents and their terms."""

    weight: np.ndarray
    docs: int
    length: int


def weights_of(vectors: DataFrame, terms: int) -> Weights:
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    docs, length = total["docs"], total["length"] or 0
    df = np.zeros(terms, np.int64)
    found = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df[found.column("t").to_numpy()] = found.column("count").to_numpy()
    weight = np.array([floor(1000 * log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return Weights(weight, docs, length)


class Rows(NamedTuple):
    """Documents of a batch as rows of a sparse matrix."""

    ids: list
    first: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    norm: np.ndarray


def rows_of(batch: pa.RecordBatch, w: Weights) -> Rows:
    """Impacts, which are integers, and lengths; terms of weight 0 add to no score and count for nothing."""
    lists, tfs = batch.column("terms"), batch.column("tfs")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
    m = 100 - 25 + (25 * batch.column("n").to_numpy() * w.docs) // max(w.length, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
    impact[w.weight[term] == 0] = 0
    # Each row is summed alone: a running sum would carry the rounding of the rows before.
    squares = np.append(impact.astype(np.float64) ** 2, 0.0)
    norm = np.sqrt(np.add.reduceat(squares, first[:-1]) * (sizes > 0)) if len(sizes) else np.empty(0)
    ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else []
    return Rows(ids, first, term, impact, norm)


def in_buckets(vectors: DataFrame, w: Weights) -> DataFrame:
    """``vectors`` with their length, in falling order of it over all partitions; ``bucket`` is the partition's number.

    Documents without a vector (no query term, or terms of weight 0 alone) score 0 and are left out.
    """

    def measured(batches):
        for batch in batches:
            norm = pa.array(rows_of(batch.drop_columns(["doc_id"]), w).norm)
            yield pa.RecordBatch.from_arrays([*batch.columns, norm], names=[*batch.schema.names, "norm"])

    kind = dict(vectors.dtypes)["doc_id"]
    known = vectors.mapInArrow(measured, f"doc_id {kind}, n long, terms array<int>, tfs array<int>, norm double").where("norm > 0")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    falling = [F.desc("norm"), F.xxhash64("doc_id").asc()]
    ordered = known.repartitionByRange(n, *falling).sortWithinPartitions(*falling)
    return materialize(ordered.withColumn("bucket", F.spark_partition_id()), "norm-buckets")


# ---------------------------------------------------------------------- search


class Searcher:
    """Best documents of a block of queries among the rows it is shown, longest vectors first."""

    def __init__(self, asked: Queries, w: Weights, bounds: np.ndarray, k: int):
        self.k, self.w = k, w
        self.first = np.searchsorted(asked.query, np.arange(len(asked.keys) + 1))
        self.term, self.times = asked.term, asked.times
        self.value = (asked.times * w.weight[asked.term]).astype(np.float64)
        self.norm = np.sqrt(np.add.reduceat(self.value**2, self.first[:-1])) if len(asked.keys) else np.empty(0)
        self.bound = np.maximum(bounds, 1)  # scores are above 0
        self.best: list[list[tuple]] = [[] for _ in asked.keys]
        self.scale = np.zeros(len(w.weight), np.int64)

    def show(self, rows: Rows) -> None:
        begin, size = 0, FIRST_BUCKET
        while begin < len(rows.norm):
            end = min(begin + size, len(rows.norm))
            self.bucket(rows, begin, end)
            begin, size = end, min(2 * size, LARGEST_BUCKET)

    def bucket(self, rows: Rows, begin: int, end: int) -> None:
        norm = rows.norm[begin:end]
        alive = np.flatnonzero(self.norm * norm.max() * (1 + MARGIN) >= self.bound)
        if not len(alive):
            return
        low, high = rows.first[begin], rows.first[end]
        term, value = rows.term[low:high], rows.impact[low:high].astype(np.float64)
        doc = np.repeat(np.arange(end - begin), np.diff(rows.first[begin : end + 1]))
        by_term = np.argsort(term, kind="stable")
        sorted_term, value, doc = term[by_term], value[by_term], doc[by_term]
        for q in alive.tolist():
            a, b = self.first[q], self.first[q + 1]
            held = self.value[a:b]
            heaviest = np.argsort(-held, kind="stable")
            share = np.cumsum(held[heaviest] ** 2)
            focus = heaviest[: int(np.searchsorted(share, FOCUS * share[-1])) + 1]
            mine = self.term[a:b][focus]
            starts, stops = np.searchsorted(sorted_term, mine, "left"), np.searchsorted(sorted_term, mine, "right")
            sizes = stops - starts
            place = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            docs, have = doc[place], value[place]
            known = np.bincount(docs, np.repeat(held[focus], sizes) * have, end - begin)
            taken = np.bincount(docs, have * have, end - begin)
            rest = max(0.0, self.norm[q] ** 2 * (1 + MARGIN) - float((held[focus] ** 2).sum()))
            left = np.maximum(norm**2 * (1 + MARGIN) - taken, 0.0)
            reach = (known + np.sqrt(rest * left)) * (1 + MARGIN)
            survivors = np.flatnonzero(reach >= self.bound[q])
            if len(survivors):
                self.score(q, rows, begin + survivors)

    def score(self, q: int, rows: Rows, docs: np.ndarray) -> None:
        """Exact scores of ``docs``; the best join the query's list and raise its bound."""
        a, b = self.first[q], self.first[q + 1]
        self.scale[self.term[a:b]] = self.times[a:b] * self.w.weight[self.term[a:b]]
        starts, sizes = rows.first[docs], rows.first[docs + 1] - rows.first[docs]
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))
        score = np.add.reduceat(self.scale[rows.term[place]] * rows.impact[place], begin)
        self.scale[self.term[a:b]] = 0
        high = score >= self.bound[q]
        docs, score = docs[high], score[high]
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            docs, score = docs[score >= least], score[score >= least]
        found = ((-s, (i is None, i)) for s, i in zip(score.tolist(), (rows.ids[d] for d in docs.tolist()), strict=True))
        self.best[q] = sorted([*self.best[q], *found], key=order_of)[: self.k]
        if len(self.best[q]) == self.k:
            self.bound[q] = max(self.bound[q], -self.best[q][-1][0])


def order_of(found: tuple) -> tuple:
    score, (no_id, doc) = found
    return (score, no_id) if no_id else (score, no_id, doc)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank) of the ``k`` best of each query; equal scores by id, null ids last."""
    line = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, asked: Queries, k: int, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """(item, doc_id, score, rank) of one block of queries."""
    spark = docs.sparkSession
    vectors = materialize(counted(docs, asked.terms), "term-counts")
    w = weights_of(vectors, len(asked.terms))
    buckets = in_buckets(vectors, w)
    last = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    bounds = np.zeros(len(asked.keys), np.int64)
    query_norm = Searcher(asked, w, bounds, k).norm
    parts, done = [], 0
    for share in rounds:
        until = max(done + 1, round(last * share))
        needed = float((np.maximum(bounds, 1) / np.maximum(query_norm, 1e-300)).min() * (1 - 2 * MARGIN))
        part = buckets.where((F.col("bucket") >= done) & (F.col("bucket") < until) & (F.col("norm") >= needed))
        sent = spark.sparkContext.broadcast((asked._replace(terms=[]), w, bounds))

        def scan(batches, sent=sent):
            asked, w, bounds = sent.value
            searcher = Searcher(asked, w, bounds, k)
            for batch in batches:
                searcher.show(rows_of(batch, w))
            found = [(asked.keys[q], i, -s) for q, best in enumerate(searcher.best) for s, (_, i) in best]
            if found:
                item, doc, score = zip(*found, strict=True)
                ids = pa.array(doc, batch.schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

        found = part.select("doc_id", "n", "terms", "tfs").mapInArrow(scan, f"item long, doc_id {kind}, score long")
        parts.append(materialize(best_of(found, k).drop("rank"), "best-documents"))
        best = best_of(reduce(DataFrame.union, parts), k)
        done = until
        if done >= last:
            break
        # One row per query of the block.
        full = best.where(F.col("rank") == k).select("item", "score").toArrow()
        place = np.searchsorted(np.array(asked.keys), full.column("item").to_numpy())
        bounds = bounds.copy()
        bounds[place] = full.column("score").to_numpy()
    return best


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` highest-scoring documents of every item, scores above 0 only.

    Every row of ``items`` is a query of its own, so repeated rows give repeated
    lists; an item without a term, or with terms of no document, has no row.
    Every row of ``docs`` is a document; null and empty texts have no term and are
    not counted.  Equal scores go by ascending id, null ids last; rows with equal
    ids take ranks of their own.
    """
    numbered = materialize(
        items.select(F.col(item_id).alias("key"), F.col(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items"
    )
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    asked = materialize(asked_terms(numbered), "item-terms")
    found = [search_block(source, block, k) for block in blocks_of(asked, block_terms)]
    schema = T.StructType([
        T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField(id, docs.schema[id].dataType), T.StructField("score", T.LongType()),
    ])
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found).join(numbered.select("item", "key"), "item").select(
        F.col("key").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id), "score"
    )
