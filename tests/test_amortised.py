import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom.functions import gradients as A
from topicloom.functions.gradients import Var
from topicloom.operators import amortised as M
from topicloom.operators.inference import fit_variational
from topicloom.sources.bundle import TopicData

KINDS = ("gamma_poisson", "multinomial", "gaussian", "bernoulli")
CASES = [
    {"weight_mode": "cell"},
    {"weight_mode": "universal", "levels": 2, "prior_type": "horseshoe", "learnable_dispersion": True},
    {"aggregation": "attention", "learnable_dispersion": True, "global_dispersion": False, "likelihood_weight_mode": "inverse_features", "feature_prior": 0.3},
    {"encoder": "sgc", "levels": 3, "weight_mode": "equal", "likelihood_weight_mode": "sqrt_inverse_features", "learnable_bg": False},
]


def fixture(n=6, **kw):
    rng = np.random.default_rng(0)
    spec = M.Spec(("a", "b", "c", "d"), (5, 4, 3, 4), KINDS, n_topics=3, n_hidden=4, att_dim=2, **kw)
    x = [rng.poisson(2, (n, 5)).astype(float), rng.poisson(1, (n, 4)).astype(float), rng.normal(size=(n, 3)), rng.integers(0, 2, (n, 4)).astype(float)]
    x[1][2] = 0
    block = M.Block(np.arange(n), x, [rng.normal(size=(n, s * (2 if spec.encoder == "sgc" else 1))) for s in spec.sizes], rng.integers(0, max(spec.levels, 1), n))
    levels = max(spec.levels, 1)
    moments = {}
    for m in range(4) if spec.encoder == "sgc" else ():
        moments |= {f"base_{m}": (rng.normal(size=(1, 4)), rng.random((1, 4)) + 0.5), f"topic_{m}": (rng.normal(size=(levels, 3)), rng.random((levels, 3)) + 0.5)}
    totals = M.Totals((3.0,) * 4, (2.0,) * 4, n, 2 * n, np.full(3, 1 / 3), moments)
    return spec, block, totals, [rng.normal(size=(1, s)) for s in spec.sizes], rng.normal(size=(n, 4)), rng


@pytest.mark.parametrize("kw", CASES)
def test_gradients_of_the_bound(kw):
    """Encoders, posteriors, weights and priors: slopes agree with differences of the whole bound, bonuses included."""
    spec, block, totals, bg, weights, rng = fixture(**kw)
    enc, glo = M.start(spec, 1)
    noise, of_cells = M.noise_of(glo, 0, 1), M.cell_noise(block.ids, 3, 0, 1)

    def value():
        groups = M.leaves(enc), M.leaves(glo), {"w": Var(weights)}
        values, kl = M.drawn(spec, groups[1], bg, noise)
        return M.cell_bound(spec, groups[0], values, block, totals, of_cells, 0.7, groups[2]["w"]) - 0.7 * kl, groups

    out, groups = value()
    out.backward()
    for params, leaves in zip((enc, glo, {"w": weights}), groups, strict=True):
        for name, v in params.items():
            at = tuple(rng.integers(0, s) for s in v.shape)
            was, h = v[at], 1e-6
            v[at] = was + h
            up = float(value()[0].value)
            v[at] = was - h
            down = float(value()[0].value)
            v[at] = was
            slope = 0.0 if leaves[name].grad is None else leaves[name].grad[at]
            assert slope == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-4), name


def plain_bound(x, level, spec, enc, glo, bg, noise, of_cells, totals, kl_weight):
    """The bound in loops over cells and modalities, for equal weights and the logistic normal."""
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    sd = lambda raw: np.log1p(np.exp(raw))
    total, thetas = 0.0, []
    k = spec.n_topics
    a = 1 / k
    sd0 = math.sqrt((1 - 2 / k) / a + k / a / k**2)
    logits = [glo[f"beta_loc_{m}"] + sd(glo[f"beta_raw_{m}"]) * noise[f"beta_{m}"] for m in range(2)]
    logits[0] = logits[0] + bg[0] + glo["bg_loc_0"] + sd(glo["bg_raw_0"]) * noise["bg_0"]
    for c in range(len(x[0])):
        means, variances = [], []
        for m in range(2):
            row = np.log1p(x[m][c] / max(x[m][c].sum(), 1) * totals.median[m])
            pre = row @ enc[f"w1_{m}"] + enc[f"b1_{m}"] + enc[f"c1_{m}"][level[c]]
            h = np.maximum((pre - pre.mean()) / np.sqrt(pre.var() + 1e-5), 0)
            means.append(h @ enc[f"w2_{m}"] + enc[f"b2_{m}"])
            variances.append(sd(h @ enc[f"w3_{m}"] + enc[f"b3_{m}"]) + 1e-4)
        has = [x[m][c].sum() > 0 for m in range(2)]
        w = [1 / sum(has) if p else 0.0 for p in has] if any(has) else [0.5, 0.5]
        mean = sum(a * b for a, b in zip(w, means, strict=True))
        var = sum(a * (v + (b - mean) ** 2) for a, b, v in zip(w, means, variances, strict=True))
        theta = soft(mean + np.sqrt(var) * of_cells[c])
        thetas.append(theta)
        part = -kl_weight * sum(math.log(sd0 / math.sqrt(v)) + (v + b * b) / (2 * sd0**2) - 0.5 for b, v in zip(mean, var, strict=True))
        part -= spec.entropy_weight * (theta * np.log(theta + 1e-5)).sum()
        for m in range(2):
            gate = 1 / (1 + np.exp(-(glo[f"gate_loc_{m}"] + sd(glo[f"gate_raw_{m}"]) * noise[f"gate_{m}"])))
            shift = glo[f"level_loc_{m}"] + sd(glo[f"level_raw_{m}"]) * noise[f"level_{m}"]
            rate = theta @ np.stack([soft(z) for z in logits[m] + gate * shift[level[c]]])
            for v, p in zip(x[m][c], rate, strict=True):
                if m == 1:
                    part += v * math.log(p + 1e-8)
                else:
                    mu, r = max(p * x[m][c].sum(), 1e-8), spec.dispersion
                    part += math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) + r * math.log(r / (r + mu)) + v * math.log(mu / (r + mu))
        total += part
    total += spec.topic_variance_weight * np.var(thetas, axis=0, ddof=1).sum()

    def kl(mean, s, s0):
        return (np.log(s0 / s) + (s**2 + mean**2) / (2 * s0**2) - 0.5).sum()

    for m in range(2):
        prior = math.sqrt((1 - 1 / spec.sizes[m]) * k)
        total -= kl_weight * kl(glo[f"beta_loc_{m}"], sd(glo[f"beta_raw_{m}"]), prior)
        e, s = noise[f"gate_{m}"], sd(glo[f"gate_raw_{m}"])
        gate = 1 / (1 + np.exp(-(glo[f"gate_loc_{m}"] + s * e)))
        total -= kl_weight * (-0.5 * e**2 - 0.5 * math.log(2 * math.pi) - np.log(s) - np.log(gate * (1 - gate)) + math.log(math.pi) + 0.5 * np.log(gate * (1 - gate))).sum()
        e, s = noise[f"level_{m}"], sd(glo[f"level_raw_{m}"])
        v = glo[f"level_loc_{m}"] + s * e
        t = math.lgamma(5.5) - math.lgamma(5) - 0.5 * math.log(10 * math.pi) - math.log(0.01) - 5.5 * np.log1p((v / 0.01) ** 2 / 10)
        total -= kl_weight * (-0.5 * e**2 - 0.5 * math.log(2 * math.pi) - np.log(s) - t).sum()
    return total - kl_weight * kl(glo["bg_loc_0"], sd(glo["bg_raw_0"]), 1.0)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    theta, rows = rng.dirichlet(np.full(3, 0.2), 50), []
    phi = [rng.dirichlet(np.full(n, 0.2), 3) for n in (9, 5)]
    x = [rng.poisson(theta @ p * depth) for p, depth in zip(phi, (60, 20), strict=True)]
    x[1][7] = 0
    for name, values in zip(("rna", "protein"), x, strict=True):
        rows += [(c, name, f"f{g}", float(v)) for c, row in enumerate(values) for g, v in enumerate(row) if v]
    cells = spark.createDataFrame([(c, "xy"[c % 2]) for c in range(50)], "cell_id long, batch string")
    ring = [(i, (i + s) % 50, 1.0) for i in range(50) for s in (1, 49)]
    counts = spark.createDataFrame(rows, "cell_id long, modality string, feature string, value double")
    return TopicData.from_counts(counts, cells, ["rna", "protein"], edges={"ring": spark.createDataFrame(ring, "src long, dst long, weight double")})


def test_distributed_bound_equals_a_plain_one(spark, data):
    spec = M.spec_of(data, {"rna": "gamma_poisson"}, "batch", n_topics=3, n_hidden=4, weight_mode="equal")
    enc, glo = M.start(spec, 2)
    rows = M.rows_of(data, spec, "batch").repartition(3).cache()
    totals = M.totals_of(data, spec)
    mean, n = M.theta_sums(rows, spec, enc, totals, 5, 9)
    totals = M.replace(totals, theta_mean=mean, n_step=n, n_all=n)
    bg = M.background_of(data, spec, 50)
    got = M.bound(rows, spec, enc, glo, bg, totals, 5, 9, 0.6)
    x = [np.zeros((50, s)) for s in spec.sizes]
    for r in data.counts.join(data.features(), ["modality", "feature"]).collect():
        x[spec.modalities.index(r.modality)][r.cell_id, r.feature_idx] = r.value
    want = plain_bound(x, np.arange(50) % 2, spec, enc, glo, bg, M.noise_of(glo, 5, 9), M.cell_noise(np.arange(50), 3, 5, 9), totals, 0.6)
    assert n == 50 and got[0] == pytest.approx(want, rel=1e-10)
    other = M.bound(rows.repartition(7), spec, enc, glo, bg, totals, 5, 9, 0.6)
    for a, b in zip(got[1:3], other[1:3], strict=True):
        assert all(np.allclose(a[k], b[k], rtol=1e-9, atol=1e-9) for k in a)


def test_multinomial_modalities_go_by_non_zeros(monkeypatch):
    """A modality of very many features takes no dense block, and slopes are those of dense arrays."""
    monkeypatch.setattr(A, "HELD", 7)
    for levels in (0, 2):
        spec = M.Spec(("a", "b"), (5, 8), ("gamma_poisson", "multinomial"), n_topics=3, n_hidden=4, levels=levels)
        rng = np.random.default_rng(2)
        full = rng.poisson(0.7, (9, 13)).astype(float)
        full[4] = 0
        rows = pd.DataFrame({"cell_id": np.arange(9), "idx": [np.flatnonzero(v) for v in full], "val": [v[v > 0] for v in full], "level": rng.integers(0, max(levels, 1), 9), "w": [np.ones(6)] * 9})
        totals = M.Totals((3.0, 4.0), (2.0, 3.0), 9, 9, np.full(3, 1 / 3))
        ((_, block),) = M.blocks([rows], spec, totals)
        assert isinstance(block.x[1], A.Rows) and isinstance(block.inputs[1], A.Rows)
        x = [full[:, :5], full[:, 5:]]
        plain = M.Block(block.ids, x, [np.log1p(v / np.maximum(v.sum(1, keepdims=True), 1) * mid) for v, mid in zip(x, totals.median, strict=True)], block.level)
        enc, glo = M.start(spec, 1)
        noise, bg = M.noise_of(glo, 0, 1), [np.zeros((1, 5)), np.zeros((1, 8))]
        got = []
        for b in (block, plain):
            e, g = M.leaves(enc), M.leaves(glo)
            values, _ = M.drawn(spec, g, bg, noise)
            out = M.cell_bound(spec, e, values, b, totals, M.cell_noise(block.ids, 3, 0, 1), 0.7)
            out.backward()
            got.append({"bound": out.value} | {n: v.grad for n, v in (e | g).items() if v.grad is not None})
        assert set(got[0]) == set(got[1]) and all(np.allclose(got[0][n], got[1][n], rtol=1e-10, atol=1e-10) for n in got[0])
    wide = M.Spec(("a",), (3_000_000,), ("multinomial",), n_topics=2, n_hidden=2)
    some = pd.DataFrame({"cell_id": np.arange(64), "idx": [np.array([c, 2_999_999 - c]) for c in range(64)], "val": [np.ones(2)] * 64, "level": 0, "w": [np.ones(3)] * 64})
    assert [len(b.x[0].val) for _, b in M.blocks([some], wide, M.Totals((1.0,), (1.0,)))] == [128]


def test_noise_is_normal_and_follows_from_its_keys():
    z = M.cell_noise(np.arange(40_000), 3, 1, 2)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs(np.corrcoef(z.T)[0, 1]) < 0.02
    assert (M.cell_noise(np.array([7, 3]), 3, 1, 2) == z[[7, 3]]).all()
    assert not np.allclose(M.cell_noise(np.arange(5), 3, 1, 3), z[:5]) and not np.allclose(M.cell_noise(np.arange(5), 3, 2, 2), z[:5])


def test_early_stopping_keeps_the_best_epoch():
    state = M.State({"p": np.array([0.0])}, {}, {})
    stopped = []
    for epoch, value in enumerate([5.0, 4.0, 3.0, 3.5, 3.2, 3.1, 2.0]):
        state.params = {"p": np.array([float(epoch)])}
        stopped.append(M.stop_early(state, value, 3))
        if stopped[-1]:
            break
    assert stopped == [False] * 5 + [True] and state.best["p"].tolist() == [2.0] and state.best_value == 3.0
    assert not M.stop_early(M.State({}, {}, {}), float("nan"), None)


def test_warm_up():
    assert [M.warm_up(e, 8, 1.0) for e in (0, 1, 2, 7)] == [0.01, pytest.approx(0.505), 1.0, 1.0]
    assert M.warm_up(0, 8, 0.5, share=0) == 0.5


def test_fit_improves_and_answers(spark, data):
    model = M.fit_amortised(data, 25, rate=0.05, validation=0.2, patience=20, covariate="batch", n_topics=3, n_hidden=16, likelihoods={"protein": "nb"})
    h = model.history
    assert len(h["elbo_train"]) == len(h["elbo_val"]) <= 25 and min(h["elbo_val"]) < h["elbo_val"][0] - 10
    assert model.state.best_value == min(h["elbo_val"])
    sums = model.theta().groupBy("cell_id").agg(F.sum("theta").alias("s")).collect()
    assert len(sums) == 50 and all(r.s == pytest.approx(1) for r in sums)
    some = model.get_latent_representation(ids=[3, 7], n_samples=4)
    assert some.count() == 6 and {r.cell_id for r in some.collect()} == {3, 7}
    assert some.orderBy("cell_id", "k").collect() == model.get_cell_topic_dist([3, 7], 4).orderBy("cell_id", "k").collect()
    assert np.isfinite(model.get_elbo()) and model.get_elbo() < 0 and np.isfinite(model.get_elbo([1, 2, 3])) and np.isfinite(model.get_perplexity())
    topics = model.get_feature_topic_dist(n_samples=20)
    assert {m: t.shape for m, t in topics.items()} == {"rna": (3, 9), "protein": (3, 5)} and all(np.allclose(t.sum(1), 1) for t in topics.values())
    weights = {(r.cell_id, r.modality): r.weight for r in model.get_modality_weights().collect()}
    assert weights[7, "rna"] == 1 and weights[7, "protein"] == 0 and len({round(w, 6) for w in weights.values()}) > 3
    assert set(model.get_state()) == set(model.state.params)


def test_resumed_fit_equals_an_unbroken_one(spark, data, tmp_path):
    how = {"n_topics": 3, "n_hidden": 4, "warmup": 0, "steps_per_epoch": 2, "validation": 0.1}
    whole = M.fit_amortised(data, 4, **how)
    M.fit_amortised(data, 2, **how).save(str(tmp_path / "model"))
    loaded = M.AmortisedModel.load(data, str(tmp_path / "model"))
    on = M.fit_amortised(data, 4, warmup=0, steps_per_epoch=2, validation=0.1, resume=loaded)
    assert on.state.epoch == 4 and np.allclose(on.history["elbo_train"], whole.history["elbo_train"], rtol=1e-9)
    for n, v in whole.state.params.items():
        assert np.allclose(on.state.params[n], v, rtol=1e-7, atol=1e-9), n
    key = lambda m: np.array([r.theta for r in m.theta().orderBy("cell_id", "k").collect()])
    assert np.allclose(key(on), key(whole), rtol=1e-7)
    told = json.loads(spark.read.text(f"{tmp_path}/model/state").head()[0])
    spark.createDataFrame([(json.dumps(told | {"version": 9}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/model/state")
    with pytest.raises(ValueError, match="version"):
        M.AmortisedModel.load(data, str(tmp_path / "model"))


def test_propagated_features_encoder(spark, data):
    model = M.fit_amortised(data, 2, graph="ring", covariate="batch", n_topics=3, n_hidden=4, weight_mode="equal")
    assert model.spec.encoder == "sgc" and model.theta().count() == 150 and np.isfinite(model.history["elbo_train"]).all()
    # After normalisation the modality's topics have mean 0 and variance 1 over each level's cells.
    enc, _ = model._split()
    totals = M.moments(model.rows, model.spec, enc, model.totals)
    rows = model.rows.toPandas()
    for _, block in M.blocks([rows], model.spec, totals):
        p = M.leaves(enc)
        at = M.location(model.spec, p, M.hidden(model.spec, p, block, 0, totals), block, 0, totals).value - enc["shift_0"][block.level]
        for level in (0, 1):
            own = at[block.level == level]
            assert np.allclose(own.mean(0), 0, atol=1e-9) and np.allclose(own.std(0), 1, atol=0.02)
    with pytest.raises(KeyError):
        M.fit_amortised(data, 1, graph="nowhere")


def test_horseshoe_and_continuous_values(spark):
    rng = np.random.default_rng(8)
    rows = [(c, m, f"f{g}", float(v)) for c in range(20) for m, n in (("rna", 4), ("harmony", 3)) for g, v in enumerate(rng.poisson(3, n) if m == "rna" else rng.normal(size=n))]
    data = TopicData.from_counts(spark.createDataFrame(rows, "cell_id long, modality string, feature string, value double"))
    model = M.fit_amortised(data, 2, likelihoods={"harmony": "gaussian"}, n_topics=2, n_hidden=3, prior_type="horseshoe", aggregation="attention", att_dim=2)
    topics = model.get_feature_topic_dist(n_samples=3)
    assert np.allclose(topics["rna"].sum(1), 1) and (topics["harmony"].min() < 0 or abs(topics["harmony"].sum() - 2) > 1e-6)
    with pytest.raises(ValueError, match="negative"):
        fit_variational(data, 2, 1)


def test_bad_input_is_refused(data):
    sizes, kinds = (2, 2), ("nb", "multinomial")
    for kw in ({"weight_mode": "x"}, {"prior_type": "x"}, {"aggregation": "x"}, {"n_topics": 0}, {"cell_prior": (0.1, 0.2, 0.3)}, {"likelihood_weight_mode": "x"}, {"encoder": "x"}):
        with pytest.raises(ValueError):
            M.Spec(("a", "b"), sizes, kinds, **({"n_topics": 2} | kw))
    for bad in ((("a",), sizes, kinds), (("a", "b"), sizes, ("nb", "x"))):
        with pytest.raises(ValueError):
            M.Spec(*bad)
    with pytest.raises(ValueError, match="Bernoulli"):
        M.fit_amortised(data, 1, likelihoods={"rna": "bernoulli"})
    with pytest.raises(KeyError):
        M.fit_amortised(data, 1, covariate="nowhere")


def test_elementwise_gradients():
    x = Var(np.array([[0.3, 1.7], [2.2, 9.0]]))
    for f, slope in ((A.lgamma, lambda v: (math.lgamma(v + 1e-6) - math.lgamma(v - 1e-6)) / 2e-6), (A.softplus, lambda v: 1 / (1 + math.exp(-v))), (A.tanh, lambda v: 1 - math.tanh(v) ** 2)):
        f(x).sum().backward()
        assert np.allclose(x.grad, np.vectorize(slope)(x.value), rtol=1e-5)
