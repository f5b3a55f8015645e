import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import communities as C
from topicloom.operators import diffusion as D
from topicloom.operators import graph as G
from topicloom.operators import sampling as S

RNG = np.random.default_rng(6)


def edge_frame(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src long, dst long, weight double")


# ---- neighbour blocks


def plain_blocks(edges, seeds, fan_outs, seed):
    near = {}
    for s, d in sorted(set(edges)):
        near.setdefault(s, []).append(d)
    out = []
    for block, ids in seeds.items():
        nodes, frontier, links = list(ids), list(ids), []
        for hop, fan in enumerate(fan_outs, 1):
            took = []
            for c in frontier:
                n = near.get(c, [])
                for t in range(min(fan, len(n))):
                    place = t if len(n) <= fan else int(hashlib.md5(f"{seed},{hop},{block},{c},{t}".encode()).hexdigest()[:12], 16) % len(n)
                    took.append((hop, n[place], c, t))
            links += took
            frontier = sorted({n for _, n, _, _ in took} - set(nodes))
            nodes += frontier
        local = {c: i for i, c in enumerate(nodes)}
        out += [(block, hop, local[a], local[b], t) for hop, a, b, t in links]
    return sorted(out)


def test_neighbour_blocks_equal_a_plain_sampler(spark):
    edges = [(a, b) for a in range(40) for b in range(40) if a != b and RNG.random() < 0.2] + [(99, b) for b in range(40)] + [(b, 99) for b in range(40)]
    ids = RNG.permutation(40).tolist()
    seeds = {0: ids[:7], 1: ids[5:9], 2: [77]}  # blocks may share cells; 77 has no neighbours
    rows = spark.createDataFrame([(b, i, c) for b, cells in seeds.items() for i, c in enumerate(cells)], "block long, pos long, cell_id long")
    links = spark.createDataFrame(edges, "src long, dst long").withColumn("weight", F.lit(1.0))
    nodes, got = S.neighbour_blocks(links, rows, [3, 2], seed=5)
    assert sorted(map(tuple, got.collect())) == plain_blocks(edges, seeds, [3, 2], 5)
    assert len({(r.block, r["hop"], r.dst, r.draw) for r in got.collect()}) == got.count()
    for block, cells in seeds.items():
        own = [r.cell_id for r in nodes.where(F.col("block") == block).orderBy("local").collect()]
        assert own[: len(cells)] == cells and len(set(own)) == len(own)
    with pytest.raises(ValueError):
        S.neighbour_blocks(links, rows, [])


# ---- blocks of points


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_VALUES", 40)
    x = RNG.normal(size=(60, 3))
    points = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "cell_id long, point array<double>, label string")
    got = {(r.src, r.rank): r.dst for r in G.knn(points, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:4])}
    np.fill_diagonal(d, 0)
    sums = {(r.cell_id, r.label): (r.s, r.n) for r in G.distance_sums(points, "label").collect()}
    for i in range(60):
        for k, label in enumerate("ab"):
            assert sums[i, label] == (pytest.approx(d[i, k::2].sum()), 30 - (i % 2 == k))


# ---- diffusion map


def test_eigenvalues_and_pseudotime_equal_numpy(spark):
    n = 40
    x = np.sort(RNG.random(n))
    rows = [(i, j, np.exp(-(((x[i] - x[j]) / 0.1) ** 2))) for i in range(n) for j in range(i + 1, n) if abs(x[i] - x[j]) < 0.25]
    edges, nodes = edge_frame(spark, rows), spark.range(n).withColumnRenamed("id", "cell_id")
    a = np.zeros((n, n))
    for i, j, w in rows:
        a[i, j] = a[j, i] = w
    k = a / np.outer(a.sum(1), a.sum(1))
    t = k / np.sqrt(np.outer(k.sum(1), k.sum(1)))
    values, vectors = np.linalg.eigh(t)
    values, vectors = values[::-1][:5], vectors[:, ::-1][:, :5]
    got, rows = D.diffusion_map(edges, nodes, 5)
    assert np.allclose(got, values, atol=1e-9)
    mine = np.array([r.vector for r in rows.orderBy("cell_id").collect()])
    assert np.allclose(np.abs((mine * vectors).sum(0)), 1, atol=1e-6)
    pseudo = {r.cell_id: (r.distance, r.pseudotime) for r in D.diffusion_pseudotime(got, rows, 0).collect()}
    scaled = (vectors * np.where(values > 1 - 1e-9, 0, values / np.where(values > 1 - 1e-9, 1, 1 - values)))
    d = np.sqrt(((scaled - scaled[0]) ** 2).sum(1))
    assert all(pseudo[i] == (pytest.approx(d[i], abs=1e-5), pytest.approx(d[i] / d.max(), abs=1e-6)) for i in range(n))
    with pytest.raises(KeyError):
        D.diffusion_pseudotime(got, rows, 999)


def test_parts_of_a_graph_and_few_cells(spark):
    edges = edge_frame(spark, [(0, 1, 1), (1, 2, 1), (5, 6, 1), (6, 7, 1)])
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 7)], "cell_id long")
    values, vectors = D.diffusion_map(edges, nodes, 9)
    assert len(values) <= 6 and np.allclose(values[:2], 1)
    got = {r.cell_id: r.pseudotime for r in D.diffusion_pseudotime(values, vectors, 0).collect()}
    assert got[0] == pytest.approx(0, abs=1e-6) and got[2] is not None and all(got[i] is None for i in (5, 6, 7))


def test_rounds_of_the_diffusion_map_start_few_jobs(spark, monkeypatch):
    """A long ring with few chords takes many rounds; over several parts they give what one task gives, and numpy."""
    n = 300
    rows = [(i, (i + 1) % n, 1.0 + i % 3) for i in range(n)] + [(i, (i * 7) % n, 0.5) for i in range(0, n, 20) if i != (i * 7) % n]
    edges, nodes = edge_frame(spark, rows), spark.range(n + 1).withColumnRenamed("id", "cell_id")  # the last has no edges
    t = np.zeros((n + 1, n + 1))
    for r in D.transitions(edges).collect():
        t[r.src, r.dst] = r.weight
    want = np.linalg.eigvalsh(t)[::-1][:5]
    found = []
    for part in (1 << 20, 400):
        monkeypatch.setattr(D, "PART", part)
        spark.sparkContext.setJobGroup(f"diffusion-{part}", "")
        values, vectors = D.diffusion_map(edges, nodes, 5)
        found.append(np.array([r.vector for r in vectors.orderBy("cell_id").collect()]))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"diffusion-{part}"))
        assert np.allclose(values, want, atol=1e-9) and np.abs(t @ found[-1] - found[-1] * values).max() < 1e-6
        assert jobs < (40 if part > n * n else 200)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(np.abs((found[0] * found[1]).sum(0)), 1, atol=1e-6)


# ---- communities


def planted(sizes, inside, outside):
    of = np.repeat(np.arange(len(sizes)), sizes)
    n = len(of)
    return of, [(i, j, 1.0 + RNG.random()) for i in range(n) for j in range(i + 1, n) if RNG.random() < (inside if of[i] == of[j] else outside)]


def plain_modularity(rows, label, resolution=1.0):
    n = max(max(a, b) for a, b, _ in rows) + 1
    a = np.zeros((n, n))
    for i, j, w in rows:
        a[i, j] = a[j, i] = max(a[i, j], w)
    k, m = a.sum(1), a.sum()
    same = np.array(label)[:, None] == np.array(label)[None, :]
    return ((a / m - resolution * np.outer(k, k) / m**2) * same).sum()


def plain_louvain(rows):
    """One cell at a time on the dense matrix, by the whole modularity after each try; then its communities as cells."""
    n = max(max(a, b) for a, b, _ in rows) + 1
    label = list(range(n))
    groups = [[i] for i in range(n)]
    while True:
        before = plain_modularity(rows, label)
        for g in groups:
            best = max({label[j] for j in range(n)}, key=lambda c: (plain_modularity(rows, [c if i in g else x for i, x in enumerate(label)]), -c))
            if plain_modularity(rows, [best if i in g else x for i, x in enumerate(label)]) > plain_modularity(rows, label) + 1e-12:
                for i in g:
                    label[i] = best
        if plain_modularity(rows, label) <= before + 1e-12:
            return label
        groups = [[i for i in range(n) if label[i] == c] for c in sorted(set(label))]


def test_planted_communities(spark):
    of, rows = planted([8, 7, 9], 0.7, 0.06)
    edges = edge_frame(spark, rows)
    nodes = spark.range(26).withColumnRenamed("id", "cell_id")
    found = C.communities(edges, nodes)
    label = {r.cell_id: r.community for r in found.collect()}
    assert label[24] == 24 and label[25] == 25 and len(label) == 26
    mine = [label[i] for i in range(24)]
    value = plain_modularity(rows, mine)
    assert C.modularity(C.symmetric(edges), found) == pytest.approx(value)
    assert value >= plain_modularity(rows, plain_louvain(rows)) - 1e-9 and value >= plain_modularity(rows, of) - 1e-9
    assert all(label[c] == c for c in label.values()) and all(label[c] <= c for c in label)


def test_distributed_rounds_raise_modularity(spark):
    """The steps of a level as joins: moves, parts and contraction, each against the matrix."""
    rows = [(a + s, b + s, 1.0) for s in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [(3, 4, 1.0)]
    edges = C.checkpointed(C.symmetric(edge_frame(spark, rows)))
    start = spark.range(8).selectExpr("id cell_id", "id community")
    label = C.moved(edges, start)
    got = {r.cell_id: r.community for r in label.collect()}
    assert plain_modularity(rows, [got[i] for i in range(8)]) == pytest.approx(plain_modularity(rows, [0] * 4 + [1] * 4))
    parts = C.refined(edges, label)
    fine = {r.cell_id: r.community for r in parts.collect()}
    assert all(got[a] == got[b] for a in range(8) for b in range(8) if fine[a] == fine[b])
    small = C.contracted(edges, parts)
    assert small.agg(F.sum("weight")).head()[0] == pytest.approx(2 * len(rows))
    assert C.modularity(small, parts.join(label.withColumnRenamed("community", "c"), "cell_id").select(F.col("community").alias("cell_id"), F.col("c").alias("community")).distinct()) == pytest.approx(C.modularity(edges, label))


def test_rounds_leave_no_growing_estimates(spark):
    """Spark multiplies joined tables' estimated sizes; over rounds the number grew until it filled the driver."""
    bits = lambda df: len(df._jdf.queryExecution().optimizedPlan().stats().toString())
    edges = C.symmetric(edge_frame(spark, [(i, (i + 1) % 40, 1.0 + i % 7) for i in range(40)])).localCheckpoint()
    start = spark.range(40).selectExpr("id cell_id", "id community")
    assert bits(C.moved(edges, start)) < 200
    chain = spark.range(39).selectExpr("id a", "id + 1 b")
    assert bits(G.min_labels(spark.range(40).selectExpr("id v", "id c"), chain)) < 200


def test_trees_with_more_edges_than_the_driver_takes(spark, monkeypatch):
    """Paths take off cells with one neighbour until the driver can walk the rest; trees and paths come to it as arrays, not as rows."""
    g = np.random.default_rng(5)
    rows = [(i, int(g.integers(0, i)), float(g.integers(1, 9))) for i in range(1, 60)] + [(70, 71, 1.0), (80, 81, 1.0), (81, 82, 2.0), (5, 5, 1.0)]
    near, want, todo = {}, {7: 0.0}, [7]
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while todo:
        a = todo.pop()
        for b, w in near[a]:
            if b not in want:
                want[b] = want[a] + w
                todo.append(b)
    edges = edge_frame(spark, rows)
    monkeypatch.setattr(G, "_relaxed", None)
    monkeypatch.setattr(type(edges), "collect", None)
    for most in (25, 500):
        got = G.shortest_paths(edges, 7, driver_edges=most).toArrow().to_pydict()
        assert dict(zip(got["cell_id"], got["distance"], strict=True)) == want
    assert G.spanning_tree(edges, driver_edges=500).toArrow().num_rows == 62
