"""Whitening against numpy's eigenvalues of the exactly centred vectors."""

import numpy as np
import pytest

from loomcast.llm.queries import op12_whitening
from loomcast.llm.whitening import above, fit, inertia, leading_pairs, whiten


def expected(vectors):
    """Per row: deviation; and n, eigenvalues, eigenvectors and whitened values of x = floor(1024 c) + 100000."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(r, s)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return deviation, values[::-1], vectors[:, ::-1], centred


def check(rows, ids, vectors, components=8):
    deviation, values, basis, centred = expected(vectors)
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    assert len(rows) == len(ids) * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) and {c for _, c in got} == set(range(1, k + 1))
    z = np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i in ids])
    want = centred @ basis[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign(z[:, c] @ want[:, c])
        assert np.abs(z[:, c] - sign * want[:, c]).max() < 1e-7
        (share,) = {r["explained"] for r in rows if r["component"] == c + 1}
        assert share == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert [int(got[i, 1]["deviation"]) for i in ids] == deviation
    assert {r["n"] for r in rows} == {len(ids)}
    (error,) = {r["identity_error"] for r in rows}
    own = z - z.mean(axis=0)
    assert error < 1e-8 and error == pytest.approx(np.abs(own.T @ own / len(z) - np.eye(k)).max(), abs=1e-10)


def test_query_against_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    usable = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    check(op12_whitening(spark, sf).collect(), [r["vec_id"] for r in usable], [r["embedding"] for r in usable])


def test_unfit_vectors_and_other_columns(spark):
    rnd = np.random.default_rng(2)
    good = [(i, [float(c) for c in rnd.normal(size=5) * [9, 4, 2, 1, 0.5]]) for i in range(200)]
    good += [good[0], good[0], (7, [0.0] * 5)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, n int, component string")
    model = fit(df)
    rows = whiten(df, model).collect()
    assert len(rows) == 5 * len(good) and {r["n"] for r in rows} == {len(good)}
    unique = [(1000 + i, v) for i, (_, v) in enumerate(good)]
    alike = whiten(spark.createDataFrame(unique + bad, "vec_id long, embedding array<double>"), model).collect()
    check(alike, [i for i, _ in unique], [v for _, v in unique])
    assert sorted(round(r["whitened"], 9) for r in alike) == sorted(round(r["whitened"], 9) for r in rows)


def test_flat_directions_and_ties(spark):
    rows = [(i, [float(i % 3), float(i % 2), 1.0, float(i % 3)]) for i in range(60)]  # one entry constant, two alike
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(whiten(df, fit(df)).collect(), [i for i, _ in rows], [v for _, v in rows])
    square = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]  # equal eigenvalues
    df = spark.createDataFrame(square, "vec_id long, embedding array<double>")
    model = fit(df)
    assert model.identity_error < 1e-9 and model.values[0] == pytest.approx(model.values[1])


def test_large_and_exact(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rnd.uniform(-60_000, 60_000, size=3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    check(whiten(df, fit(df, components=2)).collect(), [i for i, _ in rows], [v for _, v in rows], 2)


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])] * 4):
        df = spark.createDataFrame(rows, schema)
        model = fit(df)
        assert whiten(df, model).collect() == [] and model.identity_error == 0.0


@pytest.mark.parametrize("seed", range(12))
def test_inertia_and_pairs(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 25))
    a = rnd.standard_normal((n, n))
    a = a + a.T
    if seed % 3 == 0:
        np.fill_diagonal(a, 0.0)  # pivots of two rows
    w = np.linalg.eigvalsh(a)
    up, zero, down = inertia(a)
    assert (up, down) == (int((w > 1e-12).sum()), int((w < -1e-12).sum())) or zero
    assert [above(a, s) for s in (w[0] - 1, w[-1] + 1)] == [n, 0]
    p = a @ a
    values, vectors = leading_pairs(p, 8)
    assert np.allclose(values, np.linalg.eigvalsh(p)[::-1][: len(values)], rtol=1e-9, atol=1e-12 * p.trace())
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-10
    assert np.abs(p @ vectors.T - vectors.T * values).max() < 1e-9 * p.trace()
