import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import evaluate, factors, priors
from topicloom.sources.bundle import one_covariate

RNG = np.random.default_rng(1)


def test_prior_rules():
    assert priors.cell_prior(4) == priors.cell_prior(4, 0.25) == priors.cell_prior(4, [0.25] * 4) == priors.cell_prior(4, [0.25])
    for bad in ([0.1, 0.2], 0.0):
        with pytest.raises(ValueError):
            priors.cell_prior(4, bad)
    assert priors.feature_prior(5) == 0.2 and priors.feature_prior(5, 0.7) == 0.7
    with pytest.raises(ValueError):
        priors.feature_prior(5, [0.1])


def test_draws_follow_their_laws(spark):
    features = spark.range(20_000).selectExpr("'rna' modality", "concat('f', id) feature")
    at = lambda rows, c: np.array([r[0] for r in rows.select(c).collect()])
    sd = at(priors.scale_prior(features), "sd")
    assert np.median(sd) == pytest.approx(1, abs=0.05) and np.quantile(sd, 0.9) == pytest.approx(np.tan(0.45 * np.pi), rel=0.1)
    assert len(set(at(priors.dispersion_prior(features), "dispersion"))) == 1
    assert len(set(at(priors.dispersion_prior(features, True), "dispersion"))) == 20_000
    tau, delta = priors.batch_prior(features, spark.createDataFrame([("x",), ("y",), ("x",)], "batch string"), 3)
    assert tau.count() == 3 and delta.count() == 40_000
    assert at(delta, "delta").std() == pytest.approx(0.01 * np.sqrt(10 / 8), rel=0.05)
    u = features.select(priors.uniform(0, "u", "feature").alias("u"), priors.uniform(0, "v", "feature").alias("v"))
    assert at(u, priors.beta_half(F.col("u"))).var() == pytest.approx(1 / 8, rel=0.05)
    assert np.median(at(u, priors.inverse_gamma_half(F.col("u"), F.col("v")))) == pytest.approx(2.198, rel=0.1)
    shrunk = priors.horseshoe_prior(features.limit(10), 2)
    assert shrunk.count() == 20 and shrunk.select("caux").distinct().count() == 1 and shrunk.select("delta").distinct().count() == 10
    assert sorted(shrunk.collect()) == sorted(priors.horseshoe_prior(features.limit(10).repartition(5), 2).collect())


def test_components_against_numpy(spark):
    x = RNG.normal(size=(50, 4)) @ RNG.normal(size=(4, 4))
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "cell_id long, point array<double>")
    got = np.array([r.scores for r in factors.pca(points, 2).orderBy("cell_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0))
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    assert np.allclose([r["cov"] for r in factors.covariance(points).orderBy("i", "j").collect()], np.cov(x.T).ravel())
    with pytest.raises(ValueError):
        factors.pca(points.limit(0), 2)


def test_lsi_against_numpy(spark):
    x = RNG.poisson(2, (30, 6)).astype(float)
    x[:, 0] += 1
    counts = spark.createDataFrame([(i, "rna", f"f{j}", float(x[i, j])) for i in range(30) for j in range(6) if x[i, j]], "cell_id long, modality string, feature string, value double")
    features = spark.createDataFrame([("rna", f"f{j}", j) for j in range(6)], "modality string, feature string, global_idx long")
    raised = x * 30 / x.sum(0)
    u, s, vt = np.linalg.svd(np.log1p(raised / raised.sum(1, keepdims=True) * 1e4), full_matrices=False)
    u = (u * np.where(vt[np.arange(6), np.abs(vt).argmax(1)] < 0, -1, 1))[:, :3]
    got = np.array([r.scores for r in factors.lsi(counts, features, 30, 3).orderBy("cell_id").collect()])
    assert np.allclose(got, (u - u.mean(1, keepdims=True)) / u.std(1, ddof=1, keepdims=True), atol=1e-6)


def test_forest_and_f1(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, said int")
    r = evaluate.f1_scores(rows, "label", "said").head()
    assert r.f1_macro == pytest.approx((2 / 3 + 1 / 2 + 0) / 3) and r.f1_weighted == pytest.approx((2 * 2 / 3 + 1 / 2) / 4)
    points = spark.createDataFrame([(i, [float(i % 2) + 0.1 * float(RNG.normal()), float(RNG.normal())], i % 2) for i in range(60)], "cell_id long, point array<double>, label int")
    got = evaluate.forest_scores(points, "label", folds=2, trees=5).collect()
    assert len(got) == 2 and all(r.f1_macro > 0.8 for r in got)


def test_one_covariate(spark):
    cells = spark.createDataFrame([(1, "a")], "cell_id long, batch string")
    assert one_covariate(cells, ["batch"]) == "batch"
    for bad in ([], ["batch", "cell_id"]):
        with pytest.raises(ValueError):
            one_covariate(cells, bad)
    with pytest.raises(ValueError):
        one_covariate(cells, ["batch"], ["age"])
    with pytest.raises(KeyError):
        one_covariate(cells, ["x"])
