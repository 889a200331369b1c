"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with it,
so the search estimates containment instead: the MinHash sketch of an item is
its k smallest shingle hashes, and a document is a candidate if enough of the
sketch lies in its own shingle set.  The items are partitioned by the size of
their shingle set, and each partition has its own k and number of hits: an item
of n shingles that is contained to the threshold misses m = n - ceil(t n) at
most, so of k = max(m + 1, SKETCH) sketch hashes at least k - m are hit.  With
these numbers no containing document is lost whatever its length.  Candidates
are verified by the exact share of the item's distinct shingles in the document.

The items are the query set.  They go to the tasks in blocks of a bounded number
of shingles; every block is searched in all documents.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import materialize

from . import words
from .common import small_batches, text_chunks

SIZE = 5
SHARE = 0.8
SKETCH = 8
BLOCK_SHINGLES = 2_000_000


def missable(n: np.ndarray | int, share: float):
    """Shingles that an item of ``n`` may lack and still be contained."""
    return n - np.ceil(np.asarray(n) * share - 1e-9).astype(np.int64)


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """(item, shingle, words) of every distinct shingle; items shorter than one shingle have none."""

    def made(batches):
        for batch, texts in text_chunks(batches, "text"):
            w = words.split(texts, digits=True)
            doc, hashes = words.shingles(w, size)
            first = np.flatnonzero(w.doc[: max(0, len(w.doc) - size + 1)] == w.doc[size - 1 :])
            spans = [shingle_text(w, a, size) for a in first.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(doc)), pa.array(hashes.view(np.int64)), pa.array(spans, pa.string())],
                ["item", "shingle", "words"],
            )

    source = items.where(F.col("item").isNotNull())
    schema = T.StructType([source.schema["item"], T.StructField("shingle", T.LongType()), T.StructField("words", T.StringType())])
    return small_batches(source).mapInArrow(made, schema).distinct()


def shingle_text(w: words.Words, first: int, size: int) -> str:
    """The words of a shingle, joined by one space."""
    return " ".join(
        w.codes[w.start[k] : w.end[k]].tobytes().decode("utf-32-le", "surrogatepass") for k in range(first, first + size)
    )


class Sketches:
    """Sketches and whole shingle sets of one block of items."""

    def __init__(self, item: np.ndarray, shingle: np.ndarray, text: list[str], share: float):
        order = np.lexsort((shingle, item))
        item, shingle = item[order], shingle[order]
        self.items, start, self.n = np.unique(item, return_index=True, return_counts=True)
        self.may_miss = missable(self.n, share)
        k = np.minimum(self.n, np.maximum(self.may_miss + 1, SKETCH))
        self.need = k - self.may_miss
        owner = np.repeat(np.arange(len(self.items)), self.n)
        in_sketch = np.arange(len(item)) - start[owner] < k[owner]
        sketch, owner = shingle[in_sketch], owner[in_sketch]
        by_hash = np.argsort(sketch, kind="stable")
        self.sketch, self.owner = sketch[by_hash], owner[by_hash]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.sketch >> np.uint64(42)] = True
        self.whole: dict[int, set[str]] = {}
        for i, at in zip(np.repeat(np.arange(len(self.items)), self.n).tolist(), order.tolist(), strict=True):
            self.whole.setdefault(i, set()).add(text[at])

    def candidates(self, doc: np.ndarray, shingle: np.ndarray) -> np.ndarray:
        """(doc, place of the item) pairs with enough sketch hits."""
        held = self.filter[shingle >> np.uint64(42)]
        doc, shingle = doc[held], shingle[held]
        low, high = np.searchsorted(self.sketch, shingle, "left"), np.searchsorted(self.sketch, shingle, "right")
        times = high - low
        doc, shingle, low = np.repeat(doc, times), np.repeat(shingle, times), np.repeat(low, times)
        owner = self.owner[low + np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)]
        hits = np.unique(np.stack([doc, owner, shingle.view(np.int64)]), axis=1)
        pairs, n = np.unique(hits[:2], axis=1, return_counts=True)
        return pairs[:, n >= self.need[pairs[1]]].T


def blocks_of(items: DataFrame, size: int) -> list:
    """Broadcast blocks (distinct items, place of each shingle's item, hashes, words) of whole items."""
    listed = materialize(item_shingles(items.select(F.col("item_id").alias("item"), "text"), size), "item-shingles")
    blocks = math.ceil(listed.count() / BLOCK_SHINGLES)
    sent = []
    for block in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        held = part.toArrow()
        item = held.column("item").combine_chunks().dictionary_encode()
        sent.append(items.sparkSession.sparkContext.broadcast((
            item.dictionary, item.indices.to_numpy(), held.column("shingle").to_numpy().view(np.uint64),
            held.column("words").to_pylist(),
        )))
    return sent


def contained(sketches: Sketches, texts: list[str], size: int) -> list[tuple[int, int, int, int]]:
    """(text, place of the item, shared shingles, shingles of the item) of all contained items."""
    w = words.split(texts, digits=True)
    rows, have, at = [], set(), -1
    for d, i in sketches.candidates(*words.shingles(w, size)).tolist():
        if d != at:
            at = d
            first, last = np.searchsorted(w.doc, [d, d + 1])
            have = {shingle_text(w, k, size) for k in range(first, last - size + 1)}
        whole = sketches.whole[i]
        n = len(whole & have)
        if len(whole) - n <= sketches.may_miss[i]:
            rows.append((d, i, n, len(whole)))
    return rows


def find(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item contained in a document.

    ``docs`` has (doc_id, text), ``items`` (item_id, text).  Words are lower-cased
    runs of letters and digits.  Items of fewer than ``size`` words can't be told
    from chance and match nothing, nor do items with a null id; item rows with
    the same id are one item.  Null texts are empty; rows with a null doc_id are
    searched like any others; repeated rows give repeated results.
    """
    source = docs.select("doc_id", "text")
    schema = T.StructType([
        source.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_shared", "n_item")), T.StructField("containment", T.DoubleType()),
    ])

    def search(sent) -> DataFrame:
        def scan(batches):
            names, *held = sent.value
            sketches = Sketches(*held, share)
            for batch, texts in text_chunks(batches):
                if rows := contained(sketches, texts, size):
                    d, i, n, of = (np.array(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(d)), names.take(pa.array(sketches.items[i])),
                         pa.array(n), pa.array(of), pa.array(n / of)], names=schema.names,
                    )

        return small_batches(source).mapInArrow(scan, schema)

    sent = blocks_of(items, size)
    if not sent:
        return source.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, map(search, sent))


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that contain no item; each is judged where it lies, so nothing is shuffled."""

    def without(rows: DataFrame, sent) -> DataFrame:
        def scan(batches):
            _, *held = sent.value
            sketches = Sketches(*held, share)
            for batch, texts in text_chunks(batches):
                stays = np.ones(len(texts), bool)
                stays[[r[0] for r in contained(sketches, texts, size)]] = False
                yield batch.filter(pa.array(stays))

        return small_batches(rows).mapInArrow(scan, rows.schema)

    return reduce(without, blocks_of(items, size), docs)
