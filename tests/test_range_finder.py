"""The randomised range finder against numpy."""

import numpy as np
import pytest

from topicloom.operators import factors, range_finder as R

RNG = np.random.default_rng(5)


def _entries(spark, x):
    i, j = np.nonzero(x)
    return spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j)], "cell_id long, i long, value double")


def _wide(rank=6, cells=60, columns=5000):
    """A sparse matrix of more columns than factors.MAX_FEATURES, of falling values over noise."""
    x = sum((20.0 / (k + 1)) * np.outer(RNG.normal(size=cells), RNG.normal(size=columns) * (RNG.random(columns) < 0.05)) for k in range(rank))
    return x + RNG.normal(size=x.shape) * (RNG.random(x.shape) < 0.01)


def test_values_and_vectors_of_a_wide_matrix(spark):
    x = _wide()
    assert x.shape[1] > factors.MAX_FEATURES
    got = R.leading(_entries(spark, x), 4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got.values, s[:4], rtol=1e-4) and (got.values <= s[:4] * (1 + 1e-12)).all()
    left = np.array([r.y for r in got.left.orderBy("cell_id").collect()])
    right = {r.i: r.y for r in got.right.collect()}
    right = np.array([right.get(j, [0.0] * 4) for j in range(x.shape[1])])
    assert np.allclose(left.T @ left, np.eye(4), atol=1e-8) and np.allclose(right.T @ right, np.eye(4), atol=1e-6)
    assert np.allclose(np.abs((left * u[:, :4]).sum(0)), 1, atol=1e-4)
    assert all(right[np.abs(right[:, k]).argmax(), k] > 0 for k in range(4))
    assert np.allclose((left * got.values) @ right.T, u[:, :4] * s[:4] @ vt[:4], atol=0.02 * s[0] / np.sqrt(x.shape[0]))


def test_centred_equals_principal_components(spark):
    x = RNG.normal(size=(50, 8)) @ np.diag([9, 5, 3, 2, 1, 1, 1, 1.0]) + 30
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "cell_id long, point array<double>")
    got = np.array([r.scores for r in R.principal_components(points, 3).orderBy("cell_id").collect()])
    exact = np.array([r.scores for r in factors.pca(points, 3).orderBy("cell_id").collect()])
    assert np.allclose(got, exact, atol=1e-3)


def test_semantic_index_equals_lsi(spark):
    x = RNG.poisson(2, (30, 6)).astype(float)
    x[:, 0] += 1
    counts = spark.createDataFrame([(i, "rna", f"f{j}", float(x[i, j])) for i in range(30) for j in range(6) if x[i, j]], "cell_id long, modality string, feature string, value double")
    features = spark.createDataFrame([("rna", f"f{j}", j) for j in range(6)], "modality string, feature string, global_idx long")
    got, exact = (np.array([r.scores for r in f(counts, features, 30, 3).orderBy("cell_id").collect()]) for f in (R.semantic_index, factors.lsi))
    assert np.allclose(got, exact, atol=1e-5)


def test_rank_below_the_asked_for(spark):
    x = np.outer(np.arange(1, 9), np.arange(1, 13)).astype(float) + np.outer(np.ones(8), (np.arange(12) % 2))
    got = R.leading(_entries(spark, x), 5)
    s = np.linalg.svd(x, compute_uv=False)
    assert len(got.values) == 2 and np.allclose(got.values, s[:2])
    with pytest.raises(ValueError):
        R.leading(_entries(spark, x).selectExpr("cell_id", "i", "0 * value AS value"), 2)
    with pytest.raises(ValueError):
        R.leading(_entries(spark, x).limit(0), 2)
    with pytest.raises(ValueError):
        R.leading(_entries(spark, x).selectExpr("cell_id", "i", "CASE WHEN i = 3 THEN double('NaN') ELSE value END AS value"), 2)


def test_a_tree_of_triangles(spark):
    x = RNG.normal(size=(500, 7))
    table = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "cell_id long, y array<double>").repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        r = R.triangle(table, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(r.T @ r, x.T @ x)


def test_rounds_read_packed_cells_and_join_no_entries(spark, monkeypatch):
    x = RNG.normal(size=(40, 30)) @ np.diag(1.0 / np.arange(1, 31))
    monkeypatch.setattr(R, "product", None)
    monkeypatch.setattr(R, "PIECE", 50)
    got = R.leading(_entries(spark, x), 3)
    assert np.allclose(got.values, np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-4)
