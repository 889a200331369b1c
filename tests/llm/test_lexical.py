from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadlens.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, tf, _ in counted for t in tf)
    out = []
    for item, text in items:
        scores = []
        for i, tf, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = 0
            for t, times in Counter(terms(text)).items():
                if t in tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda s: s[:2] if s[1] else s)[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(best)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def test_terms_against_the_pattern():
    rng = random.Random(2)
    some = ["A", "z", "0", "é", "É", "ß", "İ", "中", "😀", "́", "\x00", " ", "\x7f", "\x80", "-", "_", "[", "`", "{", "'"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(500)] + [None, "", "a"]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    found = lexical.Splitter()(column)
    mine = [[] for _ in texts]
    for d, a, b in zip(found.doc.tolist(), found.start.tolist(), found.end.tolist(), strict=True):
        mine[d].append(found.data[a:b].tobytes().decode())
    assert mine == [terms(t) for t in texts]


@pytest.mark.parametrize("setting", ["plain", "small buckets", "blocks"])
def test_against_every_score(spark, edge_docs, monkeypatch, setting):
    if setting == "small buckets":
        monkeypatch.setattr(lexical, "FIRST_BUCKET", 3)
        monkeypatch.setattr(lexical, "LARGEST_BUCKET", 5)
        monkeypatch.setattr(lexical, "FOCUS", 0.3)
    rng = random.Random(7)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(400)]

    def text(n):
        return " ".join(rng.choice(rare) if rng.random() < 0.15 else rng.choice(common) for _ in range(n))

    made = [(100 + i, text(rng.choice([1, 5, 40, 300]))) for i in range(250)]
    made += [(400 + i, made[5][1]) for i in range(40)]  # more equal scores than places
    made += [(700, "word " * 5000 + text(50)), (100, made[0][1])]
    docs = edge_docs.select("doc_id", "text").collect()
    docs = [tuple(r) for r in docs] + made
    items = [(1, made[5][1]), (1, made[5][1]), (2, text(40)), (3, "w1 w1 w1 r7"), (4, "the QUICK brown fox"), (5, None), (6, "..."),
             (7, "nowhere"), (None, text(15)), (8, "word end"), (9, rng.choice(rare)), (10, " ".join(common))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    block = 20 if setting == "blocks" else lexical.BLOCK_TERMS
    assert got(lexical.search(frame, asked, block_terms=block)) == plain(docs, items)
    assert got(lexical.search(frame, asked, k=3, block_terms=block)) == plain(docs, items, 3)


def test_edges(spark, edge_docs):
    asked = spark.createDataFrame([("a", "word fox")], "item_id string, text string")
    clash = edge_docs.withColumnsRenamed({"n": "item", "score": "norm", "label": "bucket", "rate": "rank"})
    found = lexical.search(clash, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() > 0
    assert lexical.search(clash.limit(0), asked).count() == 0
    assert lexical.search(clash, asked.limit(0)).count() == 0
    assert lexical.search(clash.where("text IS NULL"), asked).count() == 0


def test_bounds_leave_most_documents_unscored(spark, sf_dir, monkeypatch):
    """The same lists come from a search that scores all; with bounds few rows are scored."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").limit(10).collect()]
    words = sorted({t for _, x in items for t in terms(x)})
    number = {t: i for i, t in enumerate(words)}
    counts = [(i, Counter(terms(x)), len(terms(x))) for i, x in docs if terms(x)]
    df = Counter(t for _, tf, _ in counts for t in tf)
    n, length = len(counts), sum(c[2] for c in counts)
    w = lexical.Weights(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in words]), n, length)
    lists = [sorted((number[t], k) for t, k in tf.items() if t in number) for _, tf, _ in counts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([c[0] for c in counts]), pa.array([c[2] for c in counts]), pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.int32())),
         pa.array([[k for _, k in x] for x in lists], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    order = np.argsort(-lexical.rows_of(batch, w).norm, kind="stable")
    triples = sorted((q, number[t], k) for q, (_, x) in enumerate(items) for t, k in Counter(terms(x)).items())
    asked = lexical.Queries([i for i, _ in items], [], *(np.array(x) for x in zip(*triples, strict=True)))
    searcher = lexical.Searcher(asked, w, np.zeros(len(items), np.int64), 20)
    scored = []
    inner = searcher.score
    searcher.score = lambda q, rows, docs: (scored.append(len(docs)), inner(q, rows, docs))
    searcher.show(lexical.rows_of(batch.take(pa.array(order)), w))
    mine = sorted(((items[q][0], r + 1, i, -s) for q, best in enumerate(searcher.best) for r, (s, (_, i)) in enumerate(best)), key=str)
    assert mine == plain(docs, items)
    print(sum(scored), len(items) * len(counts))
    assert sum(scored) < 0.5 * len(items) * len(counts)
