from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from threadlens.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(number))) % 10 == 0


def plain(text):
    tests = (
        ("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in p.finditer(text) if ok(m[0])]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


ODD = [
    "a@b.cc_d@e.ff x@y z@q.r.s. %@-.-.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.03.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 2",
    "+1 (264) 555-6638, +12345678 +1234567 +49.(0)30-1234567890123 + 1234", "😀 é a@b.de 😀 +1 222 333 4444", None, "", "9" * 30_000,
    "x" * 20_000 + "@", "1-2" * 5000, "a.b@c" * 2000, "+1" + " " * 5000 + "2",
]


def test_base_spans_against_python(spark, documents, edge_docs):
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 5000)), "doc_id long, text string"))
    docs = docs.union(edge_docs.select("doc_id", "text"))
    texts = docs.collect()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", pii.joined(pii.base_spans(F.col("text"))).alias("got"))
    for r in rows.collect():
        assert r["got"] == joined(plain(r["text"])), r["doc_id"]
    assert len(texts) == docs.count()


def test_query_keeps_base_and_hashes(spark, sf_dir):
    rows = queries.op6_personal_data(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        spans = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(filter(None, joined(spans).split(","))) <= set(r["spans"].split(","))


def test_contexts_discover_identifiers_the_patterns_miss(spark):
    seeds = [(k, f"some words then mail address: user{k}@host{k}.example.org and more") for k in range(12)]
    seeds += [(100 + k, f"please ring number +1 (20{k}) 555-01{k:02d} soon") for k in range(10)]
    seeds += [(200 + k, f"in the year {1990 + k} the plan and version {k}.{k} were made, the {k} came") for k in range(12)]
    unseen = [(300, "then mail address: user77@localhost and more"), (301, "please ring number 0207 946 0123 soon"), (302, "in the year 2044 the plan")]
    docs = spark.createDataFrame(seeds + unseen + [(None, None), (303, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.extract(docs).select("doc_id", pii.joined(F.col("spans")).alias("spans")).collect()}
    text = dict(unseen)
    kind, start, end = got[300].split(":")
    assert (kind, text[300][int(start) : int(end)]) == ("email", "user77@localhost")
    kind, start, end = got[301].split(":")
    assert (kind, text[301][int(start) : int(end)]) == ("phone", "0207 946 0123")
    assert got[302] == "" and got[303] == "" and got[None] == ""
    assert all(got[200 + k] == "" for k in range(12))
    assert pii.extract(docs.limit(0)).count() == 0


def test_scores_follow_plain_rounds(spark):
    rows = [("p1", "i1", "email"), ("p1", "i2", "email"), ("p1", "i3", "email"), ("p1", "i4", None), ("p2", "i4", None), ("p2", "i1", "email"),
            ("p2", "i2", "email"), ("p2", "i3", "email"), ("p2", "i5", None), ("p3", "i1", "email"), ("p3", "i6", None)]
    each = spark.createDataFrame(rows, "pattern string, identifier string, kind string").select("identifier", "kind", F.array("pattern").alias("patterns"))
    score, good = {i: 1.0 for _, i, k in rows if k}, {}
    seeds = dict(score)
    monkey = {"share": 0.6}
    for _ in range(3):
        good = {}
        for p in {r[0] for r in rows}:
            ids = {r[1] for r in rows if r[0] == p}
            held = [score[i] for i in ids if i in score]
            if len(held) >= pii.MIN_SEEDS and sum(held) / len(ids) >= monkey["share"]:
                good[p] = sum(held) / len(ids)
        doubt = {}
        for p, i, k in rows:
            if k is None and p in good and i not in seeds:
                doubt[i] = doubt.get(i, 1.0) * max(1e-6, 1 - good[p])
        score = seeds | {i: 1 - d for i, d in doubt.items() if 1 - d >= pii.MIN_SCORE}
    before, pii.MIN_CONFIDENCE = pii.MIN_CONFIDENCE, monkey["share"]
    try:
        got = {r["pattern"]: r["confidence"] for r in pii.bootstrap(each).collect()}
    finally:
        pii.MIN_CONFIDENCE = before
    assert got.keys() == good.keys() and all(abs(got[p] - good[p]) < 1e-9 for p in good)
