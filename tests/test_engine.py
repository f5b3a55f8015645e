import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import special
from topicloom.operators import evaluate, graph, inference, kernels, likelihood, metrics, prep
from topicloom.sources.bundle import TopicData, canonical_modalities, detect_data_type, load_dataset, load_model, misaligned_cells, save_model, validate_data_type

RNG = np.random.default_rng(0)


def planted(spark, cells=60, topics=3, features=24):
    theta = RNG.dirichlet(np.full(topics, 0.1), cells)
    phi = RNG.dirichlet(np.full(features, 0.1), topics)
    x = RNG.poisson(theta @ phi * 200)
    rows = [(c, "rna" if f < features - 8 else "protein", f"f{f:02d}", float(x[c, f])) for c in range(cells) for f in range(features) if x[c, f]]
    return TopicData.from_counts(spark.createDataFrame(rows, "cell_id long, modality string, feature string, value double"), cells=spark.range(cells).withColumnRenamed("id", "cell_id"))


def test_special_functions(spark):
    x = [0.1, 0.5, 1.0, 2.5, 7.9, 8.0, 30.0, 1e4]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", special.lgamma(F.col("x")).alias("l"), special.digamma(F.col("x")).alias("d")).collect()
    for r in rows:
        assert r.l == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-11)
        assert r.d == pytest.approx(float(special.np_digamma(r.x)), rel=1e-11)
        assert special.np_lgamma(r.x) == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-11)
    assert float(special.np_digamma(1.0)) == pytest.approx(-0.5772156649015329)


def test_bundle_checks(spark):
    a = spark.createDataFrame([(1, "g1", 2.0), (2, "g2", 1.0)], "cell_id long, feature string, value double")
    b = spark.createDataFrame([(1, "p1", 1.0)], "cell_id long, feature string, value double")
    data = TopicData.from_data({"rna": a, "protein": b})
    assert data.modalities == ["rna", "protein"] and detect_data_type({}) == "dict"
    assert [r.cell_id for r in misaligned_cells(data.counts).collect()] == [2]
    assert {(r.feature, r.global_idx) for r in data.features().collect()} == {("g1", 0), ("g2", 1), ("p1", 2)}
    with pytest.raises(TypeError, match="Unsupported data type"):
        validate_data_type(3)
    with pytest.raises(ValueError):
        TopicData.from_counts(data.counts, modalities=["atac"])
    with pytest.raises(KeyError):
        TopicData.from_counts(data.counts.withColumn("layer", F.lit("x")), layer="y")
    with pytest.raises(ValueError, match="Bernoulli"):
        data.validate({"rna": "bernoulli"})
    with pytest.raises(ValueError):
        load_dataset("nowhere")
    with pytest.raises(KeyError):
        TopicData.from_tables({"a": data}, "b")


def test_modality_names():
    assert canonical_modalities(["Genes", "ADT", "atac"]) == ["rna", "protein", "chromatin"]
    for bad in (["x"], ["rna", "genes"]):
        with pytest.raises(ValueError):
            canonical_modalities(bad)


def test_half_even_rounding_and_scaling(spark):
    c = spark.createDataFrame([(1, "rna", "a", v) for v in (0.5, 1.5, 2.5, -1.0)], "cell_id long, modality string, feature string, value double")
    assert sorted(r.value for r in prep.clamp_round(c).collect()) == [0.0, 0.0, 2.0, 2.0]


def test_top_features_none_for_zero_and_one_topic_has_no_diversity(spark):
    phi = spark.createDataFrame([("rna", 0, "a", 0.5), ("rna", 0, "b", 0.5)], "modality string, k int, feature string, phi double")
    assert metrics.top_features(phi, 0).count() == 0
    assert [r.feature for r in metrics.top_features(phi, 2).orderBy("rank").collect()] == ["a", "b"]
    assert metrics.topic_diversity(phi).count() == 0


def test_expected_counts_against_loops():
    x, theta, phi = RNG.poisson(3, (3, 4)).astype(float), RNG.dirichlet([1, 1], 3), RNG.random((4, 2))
    row, idx = np.nonzero(x)
    n_ck, n_gk = kernels.expected_counts(kernels.Sparse(row, idx, x[row, idx], 3), theta, phi)
    for c in range(3):
        for k in range(2):
            want = sum(x[c, g] * theta[c, k] * phi[g, k] / ((theta[c] * phi[g]).sum() + 1e-12) for g in range(4))
            assert n_ck[c, k] == pytest.approx(want, rel=1e-9)
    assert n_gk.sum() == pytest.approx(x.sum(), rel=1e-9)


def test_fits_are_simplex_and_repeatable(spark, tmp_path):
    data = planted(spark)
    for fit, kw in ((inference.fit_gibbs, {"n_samples": 2, "burnin": 5}), (inference.fit_svem, {"n_epochs": 3, "tau0": 0}), (inference.fit_variational, {"n_epochs": 5})):
        model = fit(data, n_topics=3, **kw)
        sums = [r.s for r in model.theta().groupBy("cell_id").agg(F.sum("theta").alias("s")).collect()]
        assert len(sums) == 60 and np.allclose(sums, 1)
        assert np.isfinite(model.get_perplexity()) and model.get_perplexity() > 0  # Poisson rates above 1 may bring it below 1
        assert len(model.get_top_features_per_topic("rna", 3)["topic_0"]) == 3
    a = inference.fit_gibbs(data, n_topics=3, n_samples=1, burnin=1, seed=4)
    b = inference.fit_gibbs(TopicData(data.counts.repartition(7), data.cells.repartition(3), data.modalities), n_topics=3, n_samples=1, burnin=1, seed=4)
    assert np.allclose(a.phi_matrix, b.phi_matrix)
    save_model(str(tmp_path / "m"), a.theta(), a.phi(), {"n_topics": 3})
    theta, _, meta = load_model(spark, str(tmp_path / "m"))
    assert meta == {"n_topics": 3} and theta.count() == 180
    assert a.generate(5).select("cell_id").distinct().count() == 5


def test_registered_fits_take_all_modalities_and_default_sweeps(spark, monkeypatch):
    import inspect

    from topicloom.plans import catalogue

    for query, name in (("svem_fit", "fit_svem"), ("gibbs_fit", "fit_gibbs"), ("variational_fit", "fit_variational"), ("generate_cells", "fit_gibbs")):
        own, took = inspect.signature(getattr(inference, name)), {}

        def fit(data, took=took, **kw):
            took.update(kw, data=data)
            raise InterruptedError

        with monkeypatch.context() as m:
            m.setattr(inference, name, fit)
            m.setattr(catalogue.X, "bundle", lambda *_: "all")
            with pytest.raises(InterruptedError):
                catalogue.queries()[query](spark, "")
        assert took["data"] == "all"
        assert all(took.get(n, own.parameters[n].default) == own.parameters[n].default for n in ("n_epochs", "n_samples", "burnin") if n in own.parameters)


def test_burn_in_monitor():
    change, streak, ended = kernels.burnin_trace([1, 1, 1, 1, 9], window=2, rtol=0.1, patience=1, least=4)
    assert np.isnan(change[:3]).all() and change[3] == 0 and change[4] == pytest.approx(4)
    assert streak.tolist() == [0, 0, 0, 1, 0] and ended.tolist() == [False, False, False, True, True]


def test_svem_steps_against_dense_softmax():
    x, e_log_theta, shape = RNG.poisson(1, (4, 5)).astype(float), np.log(RNG.dirichlet([1, 1, 1], 4)), RNG.random((5, 3)) + 0.5
    rate, (row, idx) = RNG.random((5, 3)), np.nonzero(x)
    block = kernels.Sparse(row, idx, x[row, idx], 4)
    log_phi = np.log(shape / shape.sum(0))
    for got, w in (
        (kernels.svem_estep_poisson(block, e_log_theta, np.log(shape), rate), e_log_theta[:, None, :] + x[:, :, None] * np.log(shape) - rate),
        (kernels.svem_estep_dirichlet(block, e_log_theta, shape), e_log_theta[:, None, :] + x[:, :, None] * log_phi),
    ):
        rho = np.exp(w - w.max(2, keepdims=True))
        rho /= rho.sum(2, keepdims=True)
        assert np.allclose(got[0], rho.sum(1)) and np.allclose(got[1], (rho * x[:, :, None]).sum(0))
    a, b = kernels.svem_mstep(np.ones((2, 2)), np.ones((2, 2)), np.full((2, 2), 3.0), np.array([1.0, 2.0]), 0.5)
    assert np.allclose(a, 2.05) and np.allclose(b, [[1.05, 1.55], [1.05, 1.55]])
    assert kernels.sharpened(np.array([[1.0, 3.0]]), 0.5).tolist() == [[pytest.approx(0.4), pytest.approx(3.6)]]


def test_tree_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 5.0), (3, 4, 1.0)], "src long, dst long, weight double")
    tree = graph.spanning_tree(edges)
    assert {(r.a, r.b) for r in tree.collect()} == {(1, 2), (2, 3), (3, 4)}
    assert sorted(graph.spanning_tree(edges, driver_edges=0).collect()) == sorted(tree.collect())
    paths = graph.shortest_paths(tree.selectExpr("a src", "b dst", "weight"), 1)
    assert {r.cell_id: r.distance for r in paths.collect()} == {1: 0.0, 2: 1.0, 3: 3.0, 4: 4.0}


def test_paths_of_more_than_200_edges(spark):
    edges = spark.range(205).selectExpr("id src", "id + 1 dst", "1d weight").coalesce(1)
    assert {r.cell_id: r.distance for r in graph.shortest_paths(edges, 0).collect()} == {i: float(i) for i in range(206)}
    with pytest.raises(ValueError, match="negative"):
        graph.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double"), 1)


def test_pseudotime_is_of_all_vectors(spark, tmp_path):
    points = RNG.normal(0, 1, (80, 3))
    spark.createDataFrame([(i, [float(v) for v in p], 0) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    from topicloom.plans import catalogue

    assert {r.cell_id for r in catalogue.mst_pseudotime(spark, str(tmp_path)).collect()} == set(range(80))


def test_likelihoods_against_numpy(spark):
    theta, phi, x = np.array([[0.3, 0.7], [1.0, 0.0]]), np.array([[0.5, 0.5], [0.1, 0.9]]), np.array([[2.0, 0.0], [0.0, 3.0]])
    t = spark.createDataFrame([(c, k, float(theta[c, k])) for c in range(2) for k in range(2)], "cell_id long, k int, theta double")
    p = spark.createDataFrame([("rna", k, f"f{f}", float(phi[k, f])) for f in range(2) for k in range(2)], "modality string, k int, feature string, phi double")
    c = spark.createDataFrame([(i, "rna", f"f{f}", float(x[i, f])) for i in range(2) for f in range(2) if x[i, f]], "cell_id long, modality string, feature string, value double")
    rate = theta @ phi
    assert likelihood.poisson(c, t, p).head().ll == pytest.approx((x * np.log(rate + 1e-8) - rate - 1e-8).sum(), rel=1e-9)
    assert likelihood.multinomial(c, t, p).head().ll == pytest.approx((x * np.log(rate + 1e-8)).sum(), rel=1e-9)


def test_percentiles_with_ties(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0)], "cell_id long, v double")
    assert {r.cell_id: r.percentile for r in evaluate.percentile_rank(rows, "v").collect()} == {1: 0.25, 2: 0.25, 3: 1.0}


def test_registered_queries_import_without_spark():
    import __spark_entry__ as entry

    assert "top_features" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
