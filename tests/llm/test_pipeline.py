from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from threadlens.llm import mixing, queries, simhash, toxicity


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Every stage is redone by plain loops on what its predecessor kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = [docs]
    for name in list(stages)[:-1]:
        kept.append(stages[name](spark, kept[-1], sf_dir))
        assert kept[-1].schema.names == docs.schema.names
    rows = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept]

    machine = queries.toxicity_machine(spark, docs, sf_dir)
    place = toxicity.place_of(machine.buckets)
    w, v = np.array(machine.weights), np.array(machine.vectors).reshape(len(machine.weights), -1)
    for i, t in rows[0].items():
        _, terms = toxicity.chosen_terms([t or ""], place)
        raw = machine.bias + w[terms].sum() + sum(v[a] @ v[b] for k, a in enumerate(terms) for b in terms[:k])
        assert (i in rows[1]) == (1 / (1 + np.exp(-raw)) < queries.TOXIC)

    shingles = {i: set(simhash.shingle_hashes(t or "", 5).tolist()) for i, t in rows[1].items()}
    by_shingle = {}
    for i, s in shingles.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    label = {i: i for i in shingles}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = Counter(p for ids in by_shingle.values() if len(ids) < 200 for k, a in enumerate(ids) for p in ((a, b) for b in ids[k + 1 :]))
    for (a, b), n in pairs.items():
        if n >= 0.8 * (len(shingles[a]) + len(shingles[b]) - n):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    want = {i for i in shingles if root(i) == i}
    assert want <= rows[2].keys() and len(rows[2].keys() - want) <= 0.02 * (len(shingles) - len(want)) + 1

    items = [set(zip(*(x[k:] for k in range(5)), strict=False)) for x in (re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())]
    for i, t in rows[2].items():
        x = re.findall(r"[^\W_]+", (t or "").lower())
        own = set(zip(*(x[k:] for k in range(5)), strict=False))
        assert (i in rows[3]) == (not any(s and len(s & own) >= 0.8 * len(s) for s in items))

    rates = {r["source"]: r["rate"] for r in mixing.rates(kept[3], mixing.smoothed(kept[3])).collect()}
    n = kept[3].count()
    assert abs(sum(rates[r["source"]] * r["n"] for r in kept[3].groupBy("source").agg(F.count("*").alias("n")).collect()) - n) < 1e-6 * n
    mixed = kept[4].collect()
    assert abs(len(mixed) - n) < 6 * n**0.5 and {r["doc_id"] for r in mixed} <= rows[3].keys()

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [queries.END_ID], "<u4") for i, t in rows[4].items()}
    out = sorted(stages["token_output"](spark, kept[4], sf_dir).collect(), key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in mixed)
    at = 0
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]].tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)


def test_stages_take_edges(spark, edge_docs, sf_dir):
    docs = edge_docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, sf_dir)
            assert part.count() >= 0
