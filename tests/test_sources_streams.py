import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom.operators import inference, kernels, metrics, prep, summaries
from topicloom.operators.graph import label_propagation
from topicloom.sources.bundle import TopicData, history_table, kind_of, read_tsv
from topicloom.streaming.minibatch import StreamingTopics

RNG = np.random.default_rng(2)


def test_compressed_matrix_of_cells_by_features(spark, tmp_path):
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("cell\tg1\tg2\nc1\t0\t2.5\nc2\t1\t0\n")
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "m.tsv.gz"), "cell").collect())) == [("c1", "g2", 2.5), ("c2", "g1", 1.0)]


def test_history_table_fills_short_series(spark):
    got = history_table(spark, {"a": [1.0, 2.0], "b": [3.0]}).orderBy("epoch").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 3.0), (1, 2.0, None)]
    assert history_table(spark, {}).count() == 0


def test_frames_by_list(spark):
    frame = spark.createDataFrame([(1, "x", 2.0)], "cell_id long, feature string, value double")
    data = TopicData.from_list([frame, frame], ["ATAC", "genes"])
    assert data.modalities == ["ATAC", "genes"] and data.default_likelihoods() == {"ATAC": "multinomial", "genes": "gamma_poisson"}
    assert kind_of("ATAC") == "chromatin" and kind_of("harmony") == "harmony"
    with pytest.raises(ValueError):
        TopicData.from_list([frame], ["a", "b"])


def test_sampled_features_are_a_share(spark):
    counts = spark.range(40).select(F.lit(1).alias("cell_id"), F.lit("rna").alias("modality"), F.concat(F.lit("f"), "id").alias("feature"), F.lit(1.0).alias("value"))
    a, b = ({r.feature for r in prep.sampled_features(counts, 0.25, step).collect()} for step in (1, 2))
    assert len(a) == len(b) == 10 and a != b
    assert prep.sampled_features(counts, 0.25, 1).head().scale == 4 and prep.sampled_features(counts, 0.001, 1).count() == 1


@pytest.fixture(scope="module")
def data(spark):
    theta = RNG.dirichlet(np.full(2, 0.2), 30)
    x = RNG.poisson(theta @ RNG.dirichlet(np.full(8, 0.2), 2) * 80)
    rows = [(c, "rna" if g < 5 else "atac", f"f{g}", 1.0 if g >= 5 else float(v)) for c, r in enumerate(x) for g, v in enumerate(r) if v]
    return TopicData.from_counts(spark.createDataFrame(rows, "cell_id long, modality string, feature string, value double"), modalities=["rna", "atac"])


def test_factorisation_lowers_its_divergence(data):
    parts, n = inference._slices(data)
    start = inference.cell_rows(data, 2, 1.0, 0)

    def divergence(cells, h):
        frame = cells.orderBy("cell_id").toPandas()
        x, theta = inference.sparse(frame).of(parts["rna"]), np.stack(frame["theta"])
        depth = np.bincount(x.row, x.val, x.cells)
        return -float((x.val * np.log((theta @ h.T)[x.row, x.idx] * depth[x.row] + 1e-12)).sum())

    values = [divergence(*inference.nmf(start, parts["rna"], 2, seed=1, rounds=r)) for r in (1, 4, 12)]
    assert values[0] > values[1] >= values[2] - 1e-9


def test_other_names_of_chromatin_take_its_steps(data):
    model = inference.fit_svem(data, n_topics=2, n_epochs=2)
    shares = model.phi_matrix[inference._slices(data)[0]["atac"]]
    assert np.allclose(shares.sum(0), 1)  # as a Dirichlet's means, unlike rates
    told = model.diagnostics(inner_iters=3)
    assert np.isfinite(told["log_lik"]) and told["perplexity"] > 0 and 0 <= told["entropy"] <= np.log(2) + 1e-9
    sampled = inference.fit_sharetopic(data, n_topics=2, n_samples=1, burnin=1)
    assert sampled.likelihoods == {"rna": "poisson", "atac": "bernoulli"}
    assert inference.fit_gibbs(data, n_topics=2, n_samples=1, burnin=1, smart_init=True).theta().count() == 60


def test_streamed_batches_replay_and_restart(spark, tmp_path):
    batches = [spark.createDataFrame([(c, [int(i) for i in np.flatnonzero(v)], [float(x) for x in v[v > 0]]) for c, v in enumerate(RNG.poisson(1, (6, 5)))], "cell_id long, idx array<int>, val array<double>") for _ in range(3)]
    new = lambda name: StreamingTopics(spark, f"file://{tmp_path}/{name}", 5, 2, 18)
    whole = new("a")
    for i, b in enumerate(batches):
        whole.update(b, i)
        whole.update(b, i)  # delivered again
    first = new("b")
    first.update(batches[0], 0)
    later = new("b")
    for i, b in enumerate(batches):
        later.update(b, i)
    assert later.step == whole.step == 3 and np.allclose(later.a, whole.a) and np.allclose(later.b, whole.b)


def test_burn_in_windows_equal_the_trace(spark):
    runs = {r: np.concatenate([np.linspace(-50, -10, 30), -10 + RNG.normal(0, 0.01 * r, 60)]) for r in (1, 5)}
    history = spark.createDataFrame([(r, i + 1, float(v)) for r, h in runs.items() for i, v in enumerate(h)], "run long, it int, ll double")
    got = summaries.burnin_windows(history, "run", "it", "ll", window=5, rtol=1e-3, patience=3, least=20).toPandas().sort_values(["run", "it"])
    for r, h in runs.items():
        change, streak, ended = kernels.burnin_trace(h, 5, 1e-3, 3, 20)
        own = got[got["run"] == r]
        assert np.allclose(own["change"].to_numpy(float), change, equal_nan=True) and own["streak"].tolist() == streak.tolist() and own["converged"].tolist() == ended.tolist()


def test_logistic_normal_of_rows(spark):
    got = metrics.logistic_normal_rows(spark.createDataFrame([(1, [0.5, 1.0, 2.0])], "id long, a array<double>"), "id", "a").orderBy("i").collect()
    mu, sigma = metrics.logistic_normal([0.5, 1.0, 2.0])
    assert [r.mu for r in got] == pytest.approx(mu) and [r.sigma for r in got] == pytest.approx(sigma)


def test_label_propagation_settles(spark):
    """Two cells that would swap labels for ever, and two cliques."""
    pairs = [(0, 1)] + [(a + s, b + s) for s in (10, 20) for a in range(4) for b in range(a + 1, 4)]
    labels = {r.cell_id: r.community for r in label_propagation(spark.createDataFrame(pd.DataFrame(pairs, columns=["src", "dst"]).assign(weight=1.0))).collect()}
    assert len({labels[i] for i in range(10, 14)}) == len({labels[i] for i in range(20, 24)}) == 1 and labels[0] == labels[1]
