from __future__ import annotations

import numpy as np

from threadlens.llm import embeddings


def plain(rows, threshold=0.95):
    """(id, n_links, component, kept) by all pairs."""
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            good[k] = x / np.sqrt((x * x).sum())
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root(k)) if k in good else i
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((centre + 0.16 * rng.standard_normal(32)).tolist())
    rows += [rng.standard_normal(32).tolist() for _ in range(400)]
    rows += [rows[0], rows[0], [3 * x for x in rows[1]]]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31 + [float("inf")], [None] + [1.0] * 31, [1.0] * 5, [2.0] * 5]
    made = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in enumerate(rows + odd)]
    made += [(None, made[3][1]), (7, made[7][1])]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    want = plain(made)
    assert got(embeddings.near_vectors(frame)) == want
    assert got(embeddings.near_vectors(frame, max_group=12)) == want  # crowded segments in slices
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(frame).collect()}
    assert all(found[i] <= n for (i, _), n in zip(rows, near, strict=True))
    assert sum(found.values()) >= 0.99 * near.sum()


def test_calibration_holds_at_the_threshold():
    rng = np.random.default_rng(2)
    plan = embeddings.calibrate(100_000, 0.95)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * side
    project = embeddings.Projections(plan, 48)
    (a, p), (b, q) = project(x), project(y)
    hits = ((a == b) & (np.abs(p - q) <= plan.window)).sum(1)
    assert (hits >= plan.need).mean() >= 0.99
