"""Variable features by local regression, against a plain one."""

import numpy as np
import pytest

from topicloom.operators import variable_features as V

RNG = np.random.default_rng(9)


def _plain(x, y, span, knots):
    """Local quadratics at the vertices, one by one by least squares, and cubics between."""
    order = np.argsort(x, kind="stable")
    n, xs = len(x), x[order]
    v = np.unique([xs[j * (n - 1) // knots] for j in range(knots + 1)])
    q, fit, slope = min(n, max(int(n * span), 4)), [], []
    for at in v:
        h = np.sort(np.abs(x - at))[q - 1]
        w = np.where(np.abs(x - at) < h, (1 - (np.abs(x - at) / h) ** 3) ** 3, 0.0)
        a = np.vander(x - at, 3, increasing=True)
        b = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        fit.append(b[0])
        slope.append(b[1])
    i = np.clip(np.searchsorted(v, x, "right") - 1, 0, len(v) - 2)
    f, g, step = np.array(fit), np.array(slope), np.diff(v)[i]
    t = (x - v[i]) / step
    return (1 + 2 * t) * (1 - t) ** 2 * f[i] + t * (1 - t) ** 2 * step * g[i] + t**2 * (3 - 2 * t) * f[i + 1] + t**2 * (t - 1) * step * g[i + 1]


def _counts(spark, x, modality="rna"):
    i, j = np.nonzero(x)
    return spark.createDataFrame([(int(a), modality, f"f{b:03d}", float(x[a, b])) for a, b in zip(i, j)], "cell_id long, modality string, feature string, value double")


def test_scores_against_plain_regression(spark):
    cells, features = 80, 120
    x = RNG.negative_binomial(2, 1 / (1 + np.exp(RNG.normal(0, 1.5, features))), (cells, features)).astype(float)
    x[:, 0] = 0
    x[:, 1] = 3.0  # no variance
    x[:, 2] = np.where(np.arange(cells) % 8 == 0, 25, 0)  # what a variable feature looks like
    two = _counts(spark, x).unionByName(_counts(spark, x[:, :30] + 1, "protein"))
    got = V.standardised_variances(two, cells).collect()
    for name, m in (("rna", x), ("protein", x[:, :30] + 1)):
        mean, var = m.mean(0), m.var(0, ddof=1)
        use = np.flatnonzero((mean > 0) & (var > 1e-12))
        line = _plain(np.log10(mean[use]), np.log10(var[use]), 0.3, 17)
        sd = np.sqrt(10**line)
        c = np.minimum(m[:, use], mean[use] + sd * np.sqrt(cells))
        score = ((c - mean[use]) ** 2).sum(0) / (cells - 1) / sd**2
        own = {r.feature: r for r in got if r.modality == name}
        assert len(own) == (m.sum(0) > 0).sum()
        assert np.allclose([own[f"f{j:03d}"].trend for j in use], line, atol=1e-7)
        assert np.allclose([own[f"f{j:03d}"].score for j in use], score, rtol=1e-6)
    assert {r.feature: r.score for r in got if r.modality == "rna"}["f001"] == 0
    best = V.loess_hvg(two, cells, 3).where("modality = 'rna'").orderBy("rank").collect()
    assert [r.rank for r in best] == [1, 2, 3] and best[0].feature == "f002"


def test_few_and_equal_means(spark):
    rows = [("rna", f"f{j}", 2.0, 1.0 + j) for j in range(3)] + [("one", "g", 1.0, 10.0)] + [("two", "a", 1.0, 10.0), ("two", "b", 10.0, 1000.0)]
    got = {(r.modality, r.feature): r.trend for r in V.trend(spark.createDataFrame(rows, "modality string, feature string, mean double, var double")).collect()}
    assert np.allclose([got["rna", f"f{j}"] for j in range(3)], np.log10([1, 2, 3]).mean())  # all at one mean: their own
    assert got["one", "g"] == pytest.approx(1) and got["two", "a"] == pytest.approx(1) and got["two", "b"] == pytest.approx(3)
    assert V.standardised_variances(spark.createDataFrame([], "cell_id long, modality string, feature string, value double"), 5).count() == 0
    with pytest.raises(ValueError):
        V.trend(spark.createDataFrame(rows, "modality string, feature string, mean double, var double"), span=0)
