"""Faults that only tables of some size showed, brought about on small ones."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from topicloom.operators import prep as P


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dense_index_keeps_every_row_where_parts_are_merged_by_size(spark):
    rows = spark.range(0, 40000, 2).select(F.col("id").alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
    with settings(spark, **{"spark__sql__shuffle__partitions": 32, "spark__sql__adaptive__advisoryPartitionSizeInBytes": 100000, "spark__sql__adaptive__coalescePartitions__parallelismFirst": "false", "spark__sql__adaptive__coalescePartitions__minPartitionSize": 1000}):
        got = P.dense_index(rows, "key", "i").select("key", "i", F.length("wide").alias("n")).toPandas().sort_values("key")
    assert got["key"].tolist() == list(range(0, 40000, 2)) and got["i"].tolist() == list(range(20000))


def test_neighbours_and_sums_of_copies_and_of_points_far_from_zero(spark, monkeypatch):
    import numpy as np

    from topicloom.operators import graph as G

    monkeypatch.setattr(G, "PAIRS", 50)
    x = np.random.default_rng(1).normal(size=(40, 3)).repeat(3, 0) + 1000
    rows = spark.createDataFrame([(i, [float(v) for v in p], i % 2) for i, p in enumerate(x)], "cell_id long, point array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(r.src, r["rank"]): r.dst for r in G.knn(rows, 4).collect()}
    for i in range(120):
        want = sorted((round(d[i, j], 9), j) for j in range(120) if j != i)[:4]
        assert [got[i, r] for r in range(1, 5)] == [j for _, j in want]
    assert len(G.blocked(rows, [])[0].where("size(b.ids) > 0").collect()) <= 8 and G.blocked(rows, [])[1] <= 8
    for own in (False, True):
        sums = {(r.cell_id, r.label): (r.s, r.n) for r in G.distance_sums(rows, "label", own).collect()}
        assert len(sums) == (120 if own else 240)
        for (i, label), (s, n) in sums.items():
            assert abs(s - d[i, label::2].sum()) < 1e-7 and n == 60 - (i % 2 == label)


def test_draws_of_many_cells_are_those_of_each():
    import numpy as np

    from topicloom.operators import inference as I

    a, ids = np.random.default_rng(0).gamma(1.0, size=(50, 4)) * 20, [0, 7, *range(1000, 1048)]
    got = I.draw_dirichlets(a, 3, 9, ids)
    assert np.allclose(got, [I.draw_dirichlet(x, 3, 9, c) for x, c in zip(a, ids, strict=True)], rtol=1e-14, atol=0)


def test_lsi_of_more_features_than_a_square_on_the_driver_holds(spark, monkeypatch):
    import numpy as np

    from topicloom.operators import factors

    x = np.random.default_rng(2).poisson(np.random.default_rng(3).gamma(1.0, size=(40, 2)) @ np.random.default_rng(4).gamma(0.5, size=(2, 12)) * 4)
    counts = spark.createDataFrame([(i, "rna", f"f{j:02d}", float(x[i, j])) for i in range(40) for j in range(12) if x[i, j]], "cell_id long, modality string, feature string, value double")
    features = spark.createDataFrame([("rna", f"f{j:02d}", j) for j in range(12)], "modality string, feature string, global_idx long")
    want = {r.cell_id: r.scores for r in factors.lsi(counts, features, 40, 2).collect()}
    monkeypatch.setattr(factors, "MAX_FEATURES", 8)
    monkeypatch.setattr(factors, "WIDE_TOLERANCE", 1e-10)
    got = {r.cell_id: r.scores for r in factors.lsi(counts, features, 40, 2).collect()}
    assert set(got) == set(want) and max(np.abs(np.array(got[c]) - want[c]).max() for c in want) < 1e-4


def test_few_pairs_are_measured_for_nearest_points_of_many_blocks(monkeypatch):
    import numpy as np

    from topicloom.operators import graph as G

    monkeypatch.setattr(G, "STRIP", 256)
    monkeypatch.setattr(G, "TILE", 1 << 12)
    g = np.random.default_rng(5)
    x = g.normal(size=(4096, 16)) + 100
    x[50:60], x[3000:3010] = x[0], x[0]
    measured, plain = [], G._of_pairs
    monkeypatch.setattr(G, "_of_pairs", lambda a, b, i, j, metric: measured.append(len(i)) or plain(a, b, i, j, metric))
    ids = np.arange(4096)
    for metric in ("euclidean", "cosine"):
        measured.clear()
        now = G.Nearest(ids[:512], x[:512], 4, metric)
        for a in range(0, 4096, 1024):
            now.meet(ids[a : a + 1024], x[a : a + 1024])
        assert sum(measured) < 0.1 * 512 * 4096 or metric == "cosine"
        for i in range(0, 512, 7):
            d = np.sqrt(((x[i] - x) ** 2).sum(1)) if metric == "euclidean" else 1 - x @ x[i] / np.sqrt((x * x).sum(1) * (x[i] @ x[i]))
            d[i] = np.inf
            assert now.to[i].tolist() == np.lexsort((ids, np.round(d, 9)))[:4].tolist()


def test_labels_spread_by_asking_only_neighbours_of_cells_that_changed(spark, monkeypatch):
    import numpy as np

    from topicloom.operators import graph as G

    g = np.random.default_rng(6)
    edges = sorted({(int(a), int(b)) for a, b in g.integers(0, 60, (120, 2)) if a != b})
    weight = {e: float(w) for e, w in zip(edges, g.integers(1, 9, len(edges)), strict=True)}
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, weight double")
    near = {}
    for (a, b), w in weight.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = max(w, near[a].get(b, 0.0) if a in near else 0.0)
    halves = lambda t: {r.cell_id for r in spark.range(60).select(F.col("id").alias("cell_id")).where(F.pmod(F.xxhash64("cell_id", F.lit(t)), F.lit(2)) == 0).collect()}
    label, turn = {c: c for c in near}, 0
    while True:
        to = {}
        for c, others in near.items():
            votes = {label[c]: max(others.values())}
            for o, w in others.items():
                votes[label[o]] = votes.get(label[o], 0.0) + w
            to[c] = min(votes, key=lambda v: (-votes[v], v))
        if to == label:
            break
        turn += 1
        half = halves(turn)
        label = {c: to[c] if c in half else v for c, v in label.items()}
    written, plain = [], G.in_buckets
    monkeypatch.setattr(G, "in_buckets", lambda df, key, name: written.append(name) or plain(df, key, name))
    assert {r.cell_id: r.community for r in G.label_propagation(rows).collect()} == label
    assert written == ["links"]  # once for all rounds


def test_values_travel_along_edges_as_one_row_of_a_cell(spark):
    import re

    from topicloom.operators import graph as G

    x = {(c, f): float(c * 3 + f) for c in range(5) for f in range(4) if (c + f) % 3}
    edges = [(a, b, 1.0 + a) for a in range(5) for b in ((a + 1) % 5, (a + 3) % 5)]
    out = G.propagate(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(c, f, v) for (c, f), v in x.items()], "cell_id long, feature long, value double"))
    want = {}
    for a, b, w in edges:
        for f in range(4):
            if (b, f) in x:
                want[a, f] = want.get((a, f), 0.0) + w * x[b, f]
    assert {(r.cell_id, r.feature): r.value for r in out.collect()} == want
    # No long rows are moved: nothing is dealt out by cell and feature.
    assert not re.search(r"Exchange hashpartitioning\(\w+#\d+L?, \w*feature", out._jdf.queryExecution().executedPlan().toString())


def test_bounds_from_moments_lie_below_mean_distances_and_rule_most_cells_out():
    import numpy as np

    from topicloom.operators import medoid as M

    g = np.random.default_rng(7)
    ball = g.normal(size=(400, 32))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    for x, few in ((ball, True), (ball + 1000, True), (g.normal(size=(200, 3)) * 10 ** g.uniform(-2, 2, (200, 1)), False), (np.ones((9, 2)), False)):
        n, mean = len(x), x.mean(0)
        spread = np.sqrt(((x - mean) ** 2).sum(1).mean()) or 1.0
        u, y, _ = M._sides(x, mean, spread)
        tensor, size = M.Tensor(y.shape[1]), ((1 + np.sqrt((y * y).sum(1))) ** 4).sum()
        sums = [a + b for a, b in zip(tensor.of(y[:7]), tensor.of(y[7:]), strict=True)]
        for e, got in enumerate(tensor.powers(tensor.weighted(sums), u), 1):
            assert np.allclose(got, ((u @ y.T) ** e).sum(1), rtol=1e-9, atol=1e-9 * size)
        exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).sum(1) / (n - 1)
        low = M.Bound(n, size, sums, mean, spread).of(x)
        assert (low <= exact).all() and (not few or (low <= exact.min()).sum() < 0.05 * n)


def test_medoids_of_large_labels_are_measured_for_few_cells(spark, monkeypatch):
    import numpy as np

    from topicloom.operators import evaluate as E
    from topicloom.operators import medoid as M

    g = np.random.default_rng(8)
    x = g.normal(size=(900, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[600:] = x[:300]  # copies
    label = np.arange(900) % 3
    x[label == 2] += 500
    rows = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, label, strict=True))]
    rows += [(1000 + i, [2.0] * 24, 7) for i in range(20)] + [(2000, [0.0] * 24, 8), (3000, [0.0] * 24, None)]
    points = spark.createDataFrame(rows, "cell_id long, point array<double>, label int")
    want = {7: 1000}
    for c in range(3):
        own = np.flatnonzero(label == c)
        m = np.round(np.sqrt(((x[own][:, None] - x[own][None]) ** 2).sum(2)).sum(1) / (len(own) - 1), 9)
        want[c] = int(own[np.lexsort((own, m))[0]])
    assert {r.label: r.cell_id for r in E.medoids(points, "label").collect()} == want
    monkeypatch.setattr(M, "products", lambda width: F.lit(0.0))
    assert {r.label: r.cell_id for r in E.medoids(points, "label").collect()} == want
    assert M.of_large(points, "label", [0, 1, 2, 7]).count() < 60
    monkeypatch.setattr(M, "OPEN", 1)
    monkeypatch.setattr(M, "CELLS", 16)
    assert {r.label: r.cell_id for r in E.medoids(points, "label").collect()} == want


def test_a_batch_of_a_sweep_costs_what_its_entries_do(spark, monkeypatch):
    import numpy as np

    from topicloom.operators import inference as I
    from topicloom.operators import kernels as K

    g = np.random.default_rng(9)
    rows = [(c, sorted(int(i) for i in g.choice(9000, 5, False)), [1.0, 2.0, 3.0, 4.0, 5.0], [0.5, 1.5]) for c in range(40)]
    cells = spark.createDataFrame(rows, "cell_id long, idx array<int>, val array<double>, theta array<double>").repartition(3)
    phi = g.random((9000, 2))

    def kernel(batch, x):
        n_ck, p = K.expected_entries(x, batch["theta"], phi)
        return n_ck, [(x.idx, p), (np.array([9000]), np.full((1, 2), float(x.cells)))]

    monkeypatch.setattr(I, "CELLS", 7)
    now, sums = I.sweep(cells, kernel, (9001, 2))
    want = np.zeros((9001, 2))
    for c, idx, val, theta in rows:
        p = phi[idx] * theta
        p *= (np.array(val) / (p.sum(1) + 1e-12))[:, None]
        want[idx] += p
    want[9000] = 40
    assert np.allclose(sums, want) and {r.cell_id: (r.idx, r.val) for r in now.collect()} == {c: (i, v) for c, i, v, _ in rows}
    # Parameters of all features are worked off once a sweep, by no batch; A and B don't come to it.
    a, b, parts = g.random((9000, 2)) + 0.1, g.random((9000, 2)) + 0.1, {"rna": np.arange(100), "chromatin": np.arange(100, 9000)}
    x, gamma = K.Sparse(np.repeat(np.arange(3), 4), np.tile([0, 7, 99, 5000], 3), np.arange(1.0, 13.0), 3), g.random((3, 2)) + 1
    terms = I._svem_terms(parts, a, b)
    monkeypatch.setattr(K, "log_shares", None)
    elog = I.np_digamma(gamma) - I.np_digamma(gamma.sum(1, keepdims=True))
    monkeypatch.setattr(K, "summed", lambda groups, weights, n, plain=K.summed: plain(groups, weights, n) if n == 3 else 1 / 0)
    got = list(I._svem_steps(x, gamma, parts, terms, {}))
    assert [len(own.idx) for _, _, own, _ in got] == [9, 3] and [w.shape for *_, w in got] == [(9, 2), (3, 2)]
    w = elog[:, None, :] + x.of(parts["chromatin"]).val[:, None, None] * np.log(a[100:] / a[100:].sum(0))[None, [4900]]
    rho = np.exp(w - w.max(2, keepdims=True))
    assert np.allclose(got[1][3], (rho / rho.sum(2, keepdims=True))[:, 0] * x.of(parts["chromatin"]).val[:, None])


def test_a_sweep_over_parts_writes_states_only(spark, monkeypatch):
    import numpy as np
    from pyarrow import fs

    from topicloom.operators import inference as I
    from topicloom.operators import kernels as K
    from topicloom.operators import parts as P

    g = np.random.default_rng(11)
    rows = [(c * 3 - 50, *((sorted(int(i) for i in g.choice(50, 5, False)), [1.0, 2.0, 3.0, 4.0, 5.0]) if c % 4 else ([], [])), [0.5, 1.5]) for c in range(60)]
    cells = spark.createDataFrame(rows, "cell_id long, idx array<int>, val array<double>, theta array<double>").repartition(5)
    phi = g.random((50, 2))

    def kernel(batch, x):
        n_ck, p = K.expected_entries(x, batch["theta"], phi)
        return n_ck + batch["cell_id"][:, None] % 2, [(x.idx, p)]

    monkeypatch.setattr(I, "CELLS", 7)
    plain, parts = cells, P.Parts.of(cells, cells, "theta", entries=180)
    assert parts.cells == 60 and {r.cell_id: (r.idx, r.val, r.theta) for r in parts.frame("theta").collect()} == {c: (i, v, t) for c, i, v, t in rows}
    for _ in range(3):
        (plain, a), (parts, b) = I.sweep(plain, kernel, (50, 2)), I.sweep(parts, kernel, (50, 2))
        assert np.allclose(a, b)
    now = {r.cell_id: (r.idx, r.val, r.theta) for r in parts.frame("theta").collect()}
    for r in plain.collect():
        assert now[r.cell_id][:2] == (r.idx, r.val) and np.allclose(now[r.cell_id][2], r.theta)
    # Each part has its counts, written once, and its states of the last sweep and of that before.
    held = P.Arrays(parts.folder)
    left = sorted(f.base_name.split("_")[0] for f in held.files.get_file_info(fs.FileSelector(held.at)))
    assert sorted(set(left)) == ["cell", "idx", "idx-sizes", "state2", "state3", "val", "val-sizes"] and len(left) == 7 * len(parts.names)


def test_sums_of_entries_equal_plain_ones(monkeypatch):
    """Of keys with any number of entries, one with more than are held at a time among them; a block's encoder has its cells' features only."""
    import numpy as np

    from topicloom.functions import gradients as A
    from topicloom.operators import amortised as M

    g = np.random.default_rng(12)
    row = np.sort(np.concatenate([g.integers(0, 30, 200), np.full(90, 31)]))
    x = A.Rows(row, g.integers(0, 500, len(row)), g.random(len(row)), (33, 500))
    w, left = g.random((500, 4)), g.random((33, 4))
    want = np.zeros((33, 500))
    np.add.at(want, (x.row, x.idx), x.val)
    for held in (1 << 18, 64):
        monkeypatch.setattr(A, "HELD", held)
        assert np.allclose(x.over_rows(w, x.val), want @ w) and np.allclose(x.over_places(left, x.val), want.T @ left)
    block = M.Block(np.arange(33), [x], [x], np.zeros(33, np.int64))
    p, at = M._narrowed({"w1_0": w}, block)
    assert p["w1_0"].shape == (len(set(x.idx)), 4) and np.array_equal(at["w1_0"], np.unique(x.idx))
    assert np.allclose(A.times(block.inputs[0], p["w1_0"]).value, want @ w)
