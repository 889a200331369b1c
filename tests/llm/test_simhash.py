from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from threadlens.llm import simhash


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_every_link_of_a_crowded_space_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    words = {int(b) for b in base}
    for b in base:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            words.add(int(b) ^ sum(1 << int(f) for f in flips))
    words = sorted(w - (1 << 64) if w >> 63 else w for w in words)
    pairs = [(i, j) for i, j in combinations(range(len(words)), 2) if bin((words[i] ^ words[j]) & (1 << 64) - 1).count("1") <= 2]
    want = plain_components(len(words), pairs)
    distinct = spark.createDataFrame([(w,) for w in words], "fp long")
    for bound in (8192, 20):  # the small bound makes every group be cut again
        edges = [(words.index(r["a"]), words.index(r["b"])) for r in simhash.links(distinct, 2, max_group=bound).collect()]
        assert plain_components(len(words), edges) == want


def test_index_pairs_are_all_pairs_in_reach():
    rng = np.random.default_rng(5)
    bits = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64))
    bits = bits[np.argsort(simhash.gray_rank(bits))]
    for radius, exact in ((2, 0), (3, 0b111100000000)):
        got = {(int(a), int(b)) for x, y in simhash.GrayIndex(bits).pairs(radius, np.uint64(exact)) for a, b in zip(x, y, strict=True)}
        want = {
            (i, j) for i, j in combinations(range(len(bits)), 2)
            if bin(int(bits[i] ^ bits[j])).count("1") <= radius and not int(bits[i] ^ bits[j]) & exact
        }
        assert got == want


def test_gray_rank_in_both_forms(spark):
    x = [0, 1, -1, 1 << 62, -(1 << 63), 123456789012345]
    rows = spark.createDataFrame([(v,) for v in x], "v long").select("v", simhash.gray_rank_column(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == simhash.gray_rank(np.array([r["v"] for r in rows]).view(np.uint64)).view(np.int64).tolist()


def test_query_against_plain_loops(edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    label = plain_components(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {}
    for r, k in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, label, strict=True)), key=str)
    got = simhash.near_duplicates(edge_docs).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


def test_lanes_count_like_plain_sums(monkeypatch):
    monkeypatch.setattr(simhash, "LANE_ROWS", 7)
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 30, 0, 13])
    hashes = rng.integers(0, 1 << 63, 44, dtype=np.uint64)
    got = simhash.majority_bits(hashes, sizes)
    begin = np.cumsum(sizes) - sizes
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[s : s + n]) > n) for s, n in zip(begin, sizes, strict=True)]
    assert got.tolist() == want


def jaccard(a, b, size=5):
    x, y = (set(simhash.shingle_hashes(t or "", size).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_keeps_one_of_each_class(spark, documents):
    docs = documents.where("doc_id < 400")
    base = docs.where("n_chars BETWEEN 400 AND 3000").limit(60).collect()
    rng = np.random.default_rng(2)
    made = []
    for k, r in enumerate(base):
        words = r["text"].split(" ")
        near = list(words)
        near[int(rng.integers(len(near)))] = "changed"
        far = [w if rng.random() > 0.12 else "other" for w in words]
        made += [(10_000 + k, " ".join(near)), (20_000 + k, r["text"]), (30_000 + k, " ".join(far))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    kept = {r["doc_id"] for r in simhash.one_of_each(both).collect()}
    for i in texts.keys() - kept:  # nothing goes without a near text that stays or goes with it
        assert any(jaccard(texts[i], texts[j]) >= 0.8 for j in texts if j < i)
    close = [k for k in range(len(base)) if jaccard(texts[10_000 + k], base[k]["text"]) >= 0.85]
    assert len(close) > 40
    assert sum(10_000 + k in kept for k in close) <= 0.03 * len(close)
    assert not any(20_000 + k in kept for k in range(len(base)))


def test_one_of_each_edges(edge_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 2 is 1 in other case; 4, 5 and the null texts have no words, as 3 has none.
    assert [i for none, i in ids if not none] == [1, 3, 6, 7, 8, 9]
    assert sum(none for none, _ in ids) == 1
    assert simhash.one_of_each(edge_docs.limit(0)).count() == 0


def test_many_equal_words_are_cut_into_slices(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [(i, base.replace(f"w{i} ", f"x{i} ", 1)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = simhash.similar_texts(docs, max_group=8)
    assert found.select("component").distinct().count() == 1


def test_slices_lose_no_pair(spark):
    rows = [("0", 7, i * 0x9E3779B97F4A7C15 % (1 << 62)) for i in range(60)] + [("0", 8, i) for i in range(5)]
    got = simhash.sliced(spark.createDataFrame(rows, "path string, key long, text_hash long"), 8).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["path"], r["key"]), []).append(r["text_hash"])
    met = {pair for (_, key), held in groups.items() if key == 7 for pair in combinations(sorted(held), 2)}
    assert met == set(combinations(sorted(h for _, key, h in rows if key == 7), 2))
    assert sorted(groups["0", 8]) == [0, 1, 2, 3, 4]
    assert all(len(held) == len(set(held)) for held in groups.values())


def test_true_link_behind_failing_forest_edges(spark):
    """A-B and B-C have a Jaccard similarity below 0.8, A-C one above it, often with the more distant fingerprints."""
    def changed(words, at):
        return " ".join("new" + w if i in at else w for i, w in enumerate(words))

    rows = []
    for k in range(150):
        words = [f"{k}w{i}" for i in range(200)]
        a, b, c = changed(words, ()), changed(words, (10, 30, 50, 70, 90)), changed(words, (70, 90, 110, 130))
        assert jaccard(a, b) < 0.8 and jaccard(b, c) < 0.8 <= jaccard(a, c)
        rows += [(3 * k, a), (3 * k + 1, b), (3 * k + 2, c)]
    found = {r["id"]: r["component"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = [found[3 * k] == found[3 * k + 2] for k in range(150)]
    assert all(joined)
    assert all(found[3 * k + 1] not in (found[3 * k], found[3 * k + 2]) for k in range(150))


def test_set_links_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = [rng.choice(1000, 30, replace=False) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(30) < 0.06, rng.integers(1000, 2000, 30), base[i % 6])) for i in range(60)]
    near = [(i, j) for i, j in combinations(range(60), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    lists = pa.array([[], *(x.tolist() for x in sets)], pa.list_(pa.int64())).slice(1)
    got = list(simhash.set_links(lists, np.arange(60), 0.8))
    assert set(got) <= set(near) and plain_components(60, got) == plain_components(60, near)


def test_short_texts_are_joined_at_every_length(spark):
    rows, pairs = [], []
    for words in (*range(8, 30, 3), 40):  # words added up to a similarity of 0.8
        for k in range(60):
            base = [f"{words}x{k}y{i}" for i in range(words)]
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, *(f"z{i}" for i in range(max(1, (words - 4) // 4)))]))]
    texts = dict(rows)
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in pairs)
    found = {r["id"]: r["component"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [i for i, j in pairs if found[i] != found[j]]
    assert not [i for i in lost if len(simhash.shingle_hashes(texts[i], 5)) <= simhash.SHORT]
    assert len(lost) <= 0.02 * len(pairs)  # beyond, the index is built for 0.99
    assert len(set(found.values())) == len(pairs) + len(lost)


def test_bits_of_small_sets_differ_more_often():
    assert simhash.differing(4, 0, 1) == 0.1875
    assert 0.1515 < simhash.most_differing(0.8) < 0.16
