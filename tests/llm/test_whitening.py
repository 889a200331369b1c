from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import queries, whitening


def orthogonal(rng, n):
    return np.linalg.qr(rng.standard_normal((n, n)))[0]


def wilkinson(copies=1, glue=0.0):
    w = np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    out = np.kron(np.eye(copies), w)
    for k in range(21, 21 * copies, 21):
        out[k - 1, k] = out[k, k - 1] = glue
    return np.linalg.cholesky(out).T


RNG = np.random.default_rng(0)
SPECTRA = {
    "falling": np.arange(40, 0, -1.0), "graded": 10.0 ** -np.arange(40), "equal": np.ones(40), "pairs": np.repeat(np.arange(20, 0, -1.0), 2),
    "near": 1 + 1e-9 * np.arange(40), "nearer": np.r_[1 + 1e-13 * np.arange(5), np.full(35, 1e-3)], "low rank": np.r_[3, 2, 1.0, np.zeros(37)],
    "none": np.zeros(40),
}
MATRICES = {k: orthogonal(RNG, 40) @ np.diag(v) @ orthogonal(RNG, 40) for k, v in SPECTRA.items()} | {
    "random": RNG.standard_normal((64, 64)), "huge": RNG.standard_normal((30, 30)) * 1e150, "small": RNG.standard_normal((30, 30)) * 1e-150,
    "wilkinson": wilkinson(), "glued": wilkinson(3, 1e-9), "one": np.array([[3.0]]), "diagonal": np.diag([1.0, 0, 2, 0]), "identity": np.eye(7),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver_against_the_svd(name):
    a = MATRICES[name]
    values, vectors, shares = whitening.solve(a, 1, 8)
    size = np.abs(a).max() or 1.0
    _, sigma, _ = np.linalg.svd(a / size)
    rank = int((sigma > 1e-13 * sigma[0]).sum()) if sigma[0] else 0
    assert len(values) == min(8, rank, len(a))
    got = np.array(values) / size / size
    assert np.allclose(got, sigma[: len(values)] ** 2, rtol=1e-11 if name == "graded" else 1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
    b = a / size
    assert np.abs(b.T @ (b @ vectors) - vectors * got).max(initial=0) <= 1e-13 * sigma[0] ** 2
    assert np.allclose(shares, sigma[: len(values)] ** 2 / ((sigma**2).sum() or 1.0))


def test_dqds_keeps_small_values_accurate():
    """A graded bidiagonal determines every singular value to full relative accuracy."""
    b = [10.0 ** -k for k in range(12)]
    f = [0.3 * x for x in b[:-1]]
    found = whitening.dqds([x * x for x in b], [x * x for x in f])
    from fractions import Fraction

    # Sturm counts in exact arithmetic around each value
    def below(x):
        shift, count, d = Fraction(x), 0, None
        for k in range(12):
            diag = Fraction(b[k]) ** 2 + (Fraction(f[k - 1]) ** 2 if k else 0)
            off = (Fraction(b[k - 1]) * Fraction(f[k - 1])) ** 2 if k else 0
            d = diag - shift - (off / d if k else 0)
            count += d < 0
        return count

    for k, v in enumerate(reversed(found)):
        assert below(v * (1 - 1e-13)) <= k < below(v * (1 + 1e-13))


def plain(rows, components):
    """{(place of the row): (n, deviation, whitened, explained)} by one eigendecomposition per vector length."""
    out = {}
    usable = {k: v for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)}
    for dim in {len(v) for v in usable.values()}:
        places = [k for k, v in usable.items() if len(v) == dim]
        x = np.array([[math.floor(1024 * c) + 100_000 for c in usable[k]] for k in places], dtype=object)
        n, sums = len(places), x.sum(0)
        centred = ((x * n - sums) / n).astype(float)
        e, w = np.linalg.eigh(centred.T @ centred / n)
        e, w = e[::-1][:components], w[:, ::-1][:, :components]
        for k, row, c in zip(places, x, centred, strict=True):
            with np.errstate(all="ignore"):
                out[k] = n, int(((row * n - sums) ** 2).sum()), c @ w / np.sqrt(e), e / np.maximum((centred**2).sum() / n, 1e-300)
    return out


def test_whole_query_against_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((12, 12))
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(12) @ mixed]) for k in range(300)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (501, [0.0] * 12)]
    rows += [(600 + k, rng.standard_normal(3).tolist()) for k in range(40)]
    rows += [(700, None), (701, []), (702, [float("nan")] * 12), (703, [None] + [1.0] * 11), (704, [float("inf")] * 12)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, vec_id long, embedding array<double>").repartition(9)
    got = whitening.whiten(docs.withColumn("vec_id", F.col("n")), 8).collect()
    want = plain(rows, 8)
    assert sorted(r["vec_id"] for r in got) == sorted(want)
    for dim in (12, 3):
        mine = [r for r in got if len(rows[r["vec_id"]][1]) == dim]
        white = np.array([r["whitened"] for r in mine])
        ref = np.array([want[r["vec_id"]][2] for r in mine])
        sign = np.sign((white * ref).sum(0))
        assert white.shape[1] == min(8, dim) and np.abs(white * sign - ref).max() < 1e-10
        for r in mine:
            n, deviation, _, explained = want[r["vec_id"]]
            assert (r["n"], int(r["deviation"])) == (n, deviation) and np.allclose(r["explained"], explained)
            assert r["identity_error"] < 1e-12
    long = whitening.components_of(docs, 8)
    assert long.count() == 303 * 8 + 40 * 3 and long.where("vec_id IS NULL").count() == 8


def test_degenerate_lists(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, deviation string")
    assert whitening.components_of(frame([])).count() == 0
    one = whitening.components_of(frame([(1, [0.5, 0.25], 7, "x")])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    line = whitening.components_of(frame([(k, [k / 1024, 2 * k / 1024, 3.0], None, None) for k in range(5)])).collect()
    by = {(r["vec_id"], r["component"]): r for r in line}
    assert [abs(round(by[k, 1]["whitened"] * math.sqrt(2), 9)) for k in range(5)] == [2, 1, 0, 1, 2]
    assert all(by[k, c]["whitened"] is None and by[k, c]["explained"] == 0 for k in range(5) for c in (2, 3))
    huge = [1e300, -1e300, 1.0]
    wide = whitening.components_of(frame([(1, huge, 1, ""), (2, [1.0, 2.0, 3.0], 1, ""), (3, [0.0, 1e18, -3.0], 1, "")])).collect()
    assert len(wide) == 9 and all(r["deviation"] is None for r in wide) and all(r["identity_error"] < 1e-4 for r in wide)


def test_registered_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain([tuple(r) for r in rows], 8)
    got = queries.op12_embedding_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * len(want) and dict(queries.op12_embedding_whitening(spark, sf_dir).dtypes)["deviation"] == "bigint"
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    for c in range(8):
        mine = [r for r in got if r["component"] == c + 1]
        pairs = np.array([(r["whitened"], want[at[r["vec_id"]]][2][c]) for r in mine])
        sign = np.sign((pairs[:, 0] * pairs[:, 1]).sum())
        assert np.abs(pairs[:, 0] * sign - pairs[:, 1]).max() < 1e-9
        assert all(r["deviation"] == want[at[r["vec_id"]]][1] for r in mine)
