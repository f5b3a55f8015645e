import numpy as np
import pytest

from topicloom.operators import message_passing as G

RNG = np.random.default_rng(4)
N, F_IN, HEADS, CHANNELS = 12, 3, 2, 2
X = RNG.normal(size=(N, F_IN))
RING = [(i, (i + s) % N) for i in range(N) for s in (1, N - 1)]
HUB = [(0, i) for i in range(1, N)] + [(i, 0) for i in range(1, N)]


def dense_attention(x, edges, wl, wr, vector):
    """Messages, and edges' weights, in loops."""
    pairs = sorted({e for e in edges if e[0] != e[1]} | {(i, i) for i in range(len(x))})
    left, right, out = x @ wl, x @ wr, np.zeros((len(x), HEADS * CHANNELS))
    alphas = {}
    for i in range(len(x)):
        heard = [s for s, d in pairs if d == i]
        for h in range(HEADS):
            at = slice(h * CHANNELS, (h + 1) * CHANNELS)
            z = np.array([left[j, at] + right[i, at] for j in heard])
            score = (np.where(z > 0, z, 0.2 * z) * vector[h]).sum(1)
            a = np.exp(score - score.max())
            a /= a.sum()
            alphas |= {(j, i, h): v for j, v in zip(heard, a, strict=True)}
            out[i, at] = a @ left[heard, at]
    return out, alphas


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, x array<double>")


def gathered(df, column):
    rows = df.collect()
    out = np.zeros((N, len(rows[0][column])))
    for r in rows:
        out[r.cell_id] = r[column]
    return out


@pytest.mark.parametrize("edges", [RING, HUB])
def test_attention_forward_and_backward(spark, edges):
    wl, wr, vector = RNG.normal(size=(F_IN, 4)), RNG.normal(size=(F_IN, 4)), RNG.normal(size=(HEADS, CHANNELS))
    cells, links = frame(spark, X), spark.createDataFrame(edges, "src long, dst long")
    both = G.projected(cells, "x", {"l": wl, "r": wr})
    weights = G.attention(G.with_loops(links, cells), both, both, vector, HEADS)
    out, alphas = dense_attention(X, edges, wl, wr, vector)
    assert np.allclose(gathered(G.attended(weights, HEADS), "out"), out)
    assert {(r.src, r.dst, h): pytest.approx(a) for r in weights.collect() for h, a in enumerate(r.alpha)} == alphas
    # Backward: slopes of sum(out * g) by every parameter.
    g = RNG.normal(size=out.shape)
    grads = frame(spark, g).withColumnRenamed("x", "g")
    said, asked, dv = G.attended_backward(weights, grads, vector, HEADS)
    dl, dr = G.weight_gradient(cells, "x", said), G.weight_gradient(cells, "x", asked)
    for param, got in ((wl, dl), (wr, dr), (vector, dv)):
        want = np.zeros_like(param)
        for at in np.ndindex(param.shape):
            was = param[at]
            param[at] = was + 1e-6
            up = (dense_attention(X, edges, wl, wr, vector)[0] * g).sum()
            param[at] = was - 1e-6
            want[at] = (up - (dense_attention(X, edges, wl, wr, vector)[0] * g).sum()) / 2e-6
            param[at] = was
        assert np.allclose(got, want, rtol=1e-5, atol=1e-6)


def test_convolution_equals_the_dense_product(spark):
    a = np.eye(N)
    for s, d in RING:
        a[s, d] = 1
    d = 1 / np.sqrt(a.sum(1))
    links = spark.createDataFrame([(*e,) for e in RING], "src long, dst long")
    got = gathered(G.convolved(links, frame(spark, X), frame(spark, X).withColumnRenamed("x", "l")), "out")
    assert np.allclose(got, (d[:, None] * a * d[None, :]) @ X)


def test_encoder_equals_a_dense_one(spark):
    wl, wr, vector = RNG.normal(size=(F_IN, 4)), RNG.normal(size=(F_IN, 4)), RNG.normal(size=(HEADS, CHANNELS))
    own, second, aligned = RNG.normal(size=(F_IN, 5)), RNG.normal(size=(4, 3)), RNG.normal(size=(3, 5))
    heads = RNG.normal(size=(5, 2)), RNG.normal(size=(5, 2))
    links = spark.createDataFrame(RING, "src long, dst long")
    layers = [G.Layer(wl, wr, vector, HEADS), G.Layer(second)]
    norm = lambda v: (v - v.mean(0)) / np.sqrt(v.var(0) + 1e-5)
    a = np.eye(N)
    for s, d in RING:
        a[s, d] = 1
    d = 1 / np.sqrt(a.sum(1))
    far = norm((d[:, None] * a * d[None, :]) @ (np.maximum(norm(dense_attention(X, RING, wl, wr, vector)[0]), 0) @ second)) @ aligned
    x = X @ own
    self_ = np.maximum((x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5), 0)
    for mixing in (0.3, 1.0):
        got = G.encode(frame(spark, X), links, layers, own, *heads, mixing, aligned)
        h = mixing * self_ + (1 - mixing) * far
        assert np.allclose(gathered(got, "mean"), h @ heads[0]) and np.allclose(gathered(got, "variance"), np.log1p(np.exp(h @ heads[1])) + 1e-4)
    with pytest.raises(ValueError):
        G.encode(frame(spark, X), links, [], own, *heads)
