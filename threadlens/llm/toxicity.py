"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the first four, five and six
letters of its longer words, so that inflected forms share a term.  A linear
model adds the weights of single terms; the machine also has a weight for every
pair of terms, the product of two learned vectors, so an insult next to a group
name counts for more than the two alone.

Steps: (1) a bounded, hash-ordered sample of labelled rows; (2) per term bucket,
the documents of either label that hold it, counted over the sample in Spark;
(3) the buckets whose counts depart most from chance; (4) the machine, fitted on
the chosen buckets of the sample; (5) every text is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import materialize

from . import words
from .common import small_batches, text_chunks

BUCKET_BITS = 20
PREFIXES = (4, 5, 6)
MAX_ROWS = 20_000
MAX_TERMS = 512
MIN_Z = 6.0
FACTORS = 4
EPOCHS = 12
MIN_STEPS = 2_000


class Machine(NamedTuple):
    """``buckets[i]`` is term i; the linear weights and the vectors are in the same order."""

    buckets: list[int]
    bias: float
    weights: list[float]
    vectors: list[list[float]]


def term_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of the texts, with repeats."""
    w = words.split(texts)
    docs, hashes = [w.doc], [w.hash()]
    for k in PREFIXES:
        longer = w.end - w.start > k
        part = w._replace(start=w.start[longer])
        docs.append(w.doc[longer])
        hashes.append(part.hash(part.start + k) + np.uint64(k))
    return np.concatenate(docs), (words.mix(np.concatenate(hashes)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch, texts in text_chunks(batches):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        doc, bucket = term_buckets(texts)
        once = np.unique((doc << BUCKET_BITS) | bucket)
        toxic = label[once >> BUCKET_BITS] == 1
        held = once & ((1 << BUCKET_BITS) - 1)
        counts[1] += np.bincount(held[toxic], minlength=1 << BUCKET_BITS)
        counts[0] += np.bincount(held[~toxic], minlength=1 << BUCKET_BITS)
    found = np.flatnonzero(counts.sum(0))
    for part in np.array_split(found, max(1, len(found) // 100_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], ["bucket", "n0", "n1"]
        )


def chosen_terms(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs of the terms that the model holds."""
    doc, bucket = term_buckets(texts)
    at = place[bucket]
    held = at >= 0
    once = np.unique(doc[held] * (1 << 16) + at[held])
    return once >> 16, once & 0xFFFF


def place_of(buckets: list[int]) -> np.ndarray:
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[np.asarray(buckets, np.int64)] = np.arange(len(buckets))
    return place


def fit(rows: list[np.ndarray], label: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, Adagrad steps on small batches in a fixed random order."""
    rng = np.random.default_rng(seed)
    bias, weight = 0.0, np.zeros(n_terms + 1)
    vectors = rng.normal(0, 0.05, (n_terms + 1, FACTORS))
    weight[-1] = vectors[-1] = 0
    g_bias, g_weight, g_vectors = 1e-6, np.full(n_terms + 1, 1e-6), np.full((n_terms + 1, FACTORS), 1e-6)
    width = max([1, *(len(r) for r in rows)])
    terms = np.full((len(rows), width), n_terms, np.int32)
    for i, r in enumerate(rows):
        terms[i, : len(r)] = r
    batches = max(1, len(rows) // 256)
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = 0.2 / (1 + 2 * epoch / epochs)
        for at in np.array_split(order, batches):
            x = terms[at]
            v = vectors[x]
            total = v.sum(1)
            raw = bias + weight[x].sum(1) + 0.5 * ((total**2).sum(1) - (v**2).sum((1, 2)))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[at]) / len(at)
            d_weight = np.bincount(x.ravel(), np.repeat(error, width), n_terms + 1) + 1e-5 * weight
            d_vectors = np.zeros_like(vectors)
            np.add.at(d_vectors, x.ravel(), (error[:, None, None] * (total[:, None, :] - v)).reshape(-1, FACTORS))
            d_vectors += 1e-4 * vectors
            d_bias = error.sum()
            g_bias += d_bias**2
            g_weight += d_weight**2
            g_vectors += d_vectors**2
            bias -= rate * d_bias / np.sqrt(g_bias)
            weight -= rate * d_weight / np.sqrt(g_weight)
            vectors -= 0.25 * rate * d_vectors / np.sqrt(g_vectors)
            weight[-1] = vectors[-1] = 0
    return float(bias), weight[:-1], vectors[:-1]


def train(docs: DataFrame, labels: DataFrame, fold: Column, max_rows: int = MAX_ROWS) -> Machine:
    """Fit the machine on labelled rows for which ``fold`` (over doc_id) holds.

    ``docs`` has (doc_id, text), ``labels`` (doc_id, label).  The sample is the
    ``max_rows`` labelled ids with the smallest hashes; an id labelled twice
    counts as toxic if one label says so.  Labels other than 0 and 1 and null
    ids are left out.  Where only one label occurs, or none, the machine
    has no terms and gives that label (0 for none) to every text.
    """
    picked = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & fold)
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # The broadcast side has max_rows narrow rows at most.
    sample = materialize(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label"), "labelled")
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Machine([], 30.0 if n1 else -30.0, [], [])
    counts = small_batches(sample.select("text", "label")).mapInArrow(count_terms, "bucket long, n0 long, n1 long")
    all_n = n0 + n1
    both = F.col("n0") + F.col("n1")
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(both / all_n * (1 - both / all_n + 1e-9) * (1 / n0 + 1 / n1))
    best = (
        counts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where("n0 + n1 >= 5").withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "bucket").limit(MAX_TERMS).select("bucket").collect()
    )
    buckets = [r["bucket"] for r in best]

    def terms_of(batches):
        place = place_of(buckets)
        for batch, texts in text_chunks(batches):
            doc, term = chosen_terms(texts, place)
            lists = np.split(term, np.searchsorted(doc, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))],
                ["doc_id", "label", "terms"],
            )

    def fitted(batches):
        rows, label = [], []
        for batch in batches:
            rows += [np.asarray(x, np.int32) for x in batch.column("terms").to_pylist()]
            label += batch.column("label").to_pylist()
        if rows:
            bias, weight, vectors = fit(rows, np.asarray(label, float), len(buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bias]), pa.array([weight.tolist()], pa.list_(pa.float64())),
                 pa.array([vectors.tolist()], pa.list_(pa.list_(pa.float64())))],
                ["bias", "weights", "vectors"],
            )

    schema = f"doc_id {dict(sample.dtypes)['doc_id']}, label int, terms array<int>"
    model = (
        small_batches(sample).mapInArrow(terms_of, schema)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label", "terms").limit(max_rows)
        .coalesce(1).mapInArrow(fitted, "bias double, weights array<double>, vectors array<array<double>>")
        .first()
    )
    return Machine(buckets, model["bias"], list(model["weights"]), [list(v) for v in model["vectors"]])


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text, higher for toxic.

    A null or empty text has no terms and gets the score of the bias alone.
    ``out`` replaces a column of the same name.
    """
    rest = docs.drop(out)

    def scored(batches):
        place = place_of(machine.buckets)
        weight = np.asarray(machine.weights)
        vectors = np.asarray(machine.vectors).reshape(len(weight), FACTORS)
        for batch, texts in text_chunks(batches, text):
            raw = np.full(len(texts), machine.bias)
            if len(weight):
                doc, term = chosen_terms(texts, place)
                raw += np.bincount(doc, weight[term], len(texts))
                for v in vectors.T:
                    s = np.bincount(doc, v[term], len(texts))
                    raw += 0.5 * (s * s - np.bincount(doc, v[term] ** 2, len(texts)))
            value = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, out])

    return small_batches(rest).mapInArrow(scored, T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())]))
