from __future__ import annotations

import random

from pyspark.sql import functions as F

from threadlens.llm import lines


def near(a, b):
    """One word inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs):
    """(id, text) -> numbers of the lines that go."""
    order = {r["text_hash"]: r for r in []}
    del order
    seen, gone = [], {}
    for doc_id, _, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1])):
        if (doc_id, text) in gone:
            continue
        gone[doc_id, text] = set()
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(line.split())
            if not w:
                continue
            if w in seen or len(w) >= 5 and any(len(s) >= 5 and near(w, s) for s in seen):
                gone[doc_id, text].add(k)
            seen.append(w)
    return gone


def test_against_plain_loops(spark, edge_docs):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = []
    for _ in range(120):
        out = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split(" ")
            k = rng.random()
            if k < 0.3:
                w[rng.randrange(len(w))] = rng.choice("xyz")
            elif k < 0.5:
                w.insert(rng.randrange(len(w) + 1), rng.choice("xya"))
            elif k < 0.7:
                del w[rng.randrange(len(w))]
            out.append("  ".join(w) if k > 0.9 else " ".join(w))
        texts.append("\n".join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(edge_docs.select(F.col("doc_id") + 1000, "text"))
    docs = docs.withColumn("n_lines", F.lit("taken"))
    hashed = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    gone = plain(hashed)
    rows = lines.dedup(docs).collect()
    assert len(rows) == len(hashed)
    want = sorted(
        (str((d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d, t]) if t is not None else None)) for d, _, t in hashed)
    )
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == want
    assert sum(len(g) for g in gone.values()) > 100
    assert all(r["n_dropped"] <= r["n_lines"] for r in rows)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_a_hub_of_many_neighbours(spark):
    text = "\n".join(f"license text number {k} of this work" for k in range(300))
    row = lines.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_lines"] == 300 and row["n_dropped"] == 299 and row["text"].startswith("license text number 0")
