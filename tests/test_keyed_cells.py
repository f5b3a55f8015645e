"""Keyed state of streamed cells against one pass over their whole counts."""

import numpy as np

from topicloom.functions.special import np_digamma
from topicloom.operators import kernels as K
from topicloom.streaming import keyed_cells as S

RNG = np.random.default_rng(4)
CELLS, FEATURES, PIECES = 9, 6, 4
PARTS = RNG.poisson(0.8, (PIECES, CELLS, FEATURES)).astype(float)
A, B = RNG.gamma(2.0, size=(FEATURES, 3)), RNG.gamma(2.0, size=(FEATURES, 3)) + 0.5


def _write(spark, where, rows):
    spark.createDataFrame(rows, S.INPUT).coalesce(1).write.mode("append").parquet(where)


def _delivery(p, c):
    i = np.flatnonzero(PARTS[p, c])
    return (c, p, [int(j) for j in i], [float(v) for v in PARTS[p, c, i]])


def _plain():
    x = PARTS.sum(0)
    row, idx = np.nonzero(x)
    gamma = np.full((CELLS, 3), 1.1)
    for _ in range(3):
        n, _ = K.svem_estep_poisson(K.Sparse(row, idx, x[row, idx], CELLS), np_digamma(gamma) - np_digamma(gamma.sum(1, keepdims=True)), np_digamma(A) - np.log(B), A / B)
        gamma = 0.1 + n
    return gamma


def _same(got):
    rows = sorted(got.collect())
    assert [r.cell_id for r in rows] == list(range(CELLS)) and all(r.deliveries == PIECES for r in rows)
    assert np.allclose([r.gamma for r in rows], _plain(), rtol=1e-9)


def test_pieces_repeats_and_restarts_end_alike(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    for p in range(PIECES):
        _write(spark, at("in"), [_delivery(p, c) for c in range(CELLS)])
    _same(S.run_available(spark, at("in"), at("out"), at("check"), A, B, files_per_batch=1))
    # Other batches and order, pieces that come twice, in one file and in a later one, and an end after each piece.
    for p in reversed(range(PIECES)):
        rows = [_delivery(p, c) for c in range(CELLS)]
        _write(spark, at("in2"), rows + rows[:3] + ([_delivery(PIECES - 1, c) for c in range(4)] if p == 0 else []) + [(None, p, [1], [1.0])])
        got = S.run_available(spark, at("in2"), at("out2"), at("check2"), A, B)
    _same(got)
    again = S.run_available(spark, at("in2"), at("out2"), at("check2"), A, B)  # nothing new
    _same(again)


def test_a_table_and_empty_deliveries(spark):
    rows = [_delivery(p, c) for p in range(PIECES) for c in range(CELLS)]
    _same(S.cell_topics(S.counts_so_far(spark.createDataFrame(rows, S.INPUT)), A, B))
    got = S.counts_so_far(spark.createDataFrame([(1, 1, None, None), (1, 2, [], []), (2, 1, [0], [2.0])], S.INPUT)).orderBy("cell_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, [], []), (2, 1, [0], [2.0])]
    assert S.cell_topics(S.counts_so_far(spark.createDataFrame([], S.INPUT)), A, B).count() == 0
