"""Medoids of large labels without all pairs: a bound from below on every cell's mean distance, from moments of its label.

With w and z two cells of a label, less its mean and over its spread, and 1 + t = |w - z|^2 / 2, a distance is a multiple of
sqrt(1 + t). The cubic h that agrees with (1 + t)^-1/2 and its slope at s and -s lies below it (its fourth derivative is positive),
so that (1 + t) h(t), of degree 4, lies below sqrt(1 + t) wherever t >= -1. t is x . y + a with x = (-w, 1), y = (z, (|z|^2 - 1) / 2)
and a = (|w|^2 - 1) / 2. So the bound's sum over a label's cells follows from the sums of products of up to four components of y: one
pass adds them up, one gives every cell its bound. Cells whose bound exceeds one cell's mean distance can't be the medoid; the
others are measured against all cells.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Written, shared_dir
from .graph import distance_sums_to

#: Components of a block of pairs, cells that are worked off at a time, and labels whose moments a task holds at a time.
STEP, CELLS, OPEN = 8, 1024, 16


def products(width: Column) -> Column:
    """About the products of four of width + 1 components that are summed."""
    return F.pow(width + 2.0, F.lit(4.0)) / 18


class Tensor:
    """Sums of products of up to four of d components, and what they give for other vectors.

    Pairs (i, j), i <= j, lie in two orders: by j, and by their first component. A block of the fourth order holds the pairs of
    STEP values of j against those pairs (k, l) that begin no earlier.
    """

    def __init__(self, d: int):
        self.d, self.pairs = d, d * (d + 1) // 2
        self.j = np.repeat(np.arange(d), np.arange(1, d + 1))
        self.i = np.arange(self.pairs) - self.j * (self.j + 1) // 2
        self.k = np.repeat(np.arange(d), np.arange(d, 0, -1))
        self.l = np.concatenate([np.arange(k, d) for k in range(d)])
        self.blocks = [(slice(a * (a + 1) // 2, (e := min(a + STEP, d)) * (e + 1) // 2), slice(self.pairs - (d - a) * (d - a + 1) // 2, None)) for a in range(0, d, STEP)]
        self.twice = np.where(self.i == self.j, 1.0, 2.0)

    def by_last(self, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(y), self.pairs))
        for j in range(self.d):
            np.multiply(y[:, : j + 1], y[:, j : j + 1], out=out[:, j * (j + 1) // 2 : (j + 1) * (j + 2) // 2])
        return out

    def by_first(self, y: np.ndarray) -> np.ndarray:
        out, at = np.empty((len(y), self.pairs)), 0
        for k in range(self.d):
            np.multiply(y[:, k:], y[:, k : k + 1], out=out[:, at : at + self.d - k])
            at += self.d - k
        return out

    def of(self, y: np.ndarray) -> list[np.ndarray]:
        """First, second and third order, then the blocks of the fourth."""
        last, first = self.by_last(y), self.by_first(y)
        return [y.sum(0), last.sum(0), last.T @ y, *(last[:, r].T @ first[:, c] for r, c in self.blocks)]

    def weighted(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        """sums with the number of orders in which each product comes; those of a block that come elsewhere too get 0."""
        out = [sums[0], sums[1] * self.twice, sums[2] * self.twice[:, None]]
        for (r, c), m in zip(self.blocks, sums[3:], strict=True):
            i, j, k, l = self.i[r][:, None], self.j[r][:, None], self.k[c][None, :], self.l[c][None, :]
            ij, jk, kl = i == j, j == k, k == l
            same = np.where(ij & jk & kl, 24, np.where((ij & jk) | (jk & kl), 6, np.where(ij & kl, 4, np.where(ij | jk | kl, 2, 1))))
            out.append(m * np.where(j <= k, 24.0 / same, 0.0))
        return out

    def powers(self, weighted: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        """For each row of x: sums over y of (x . y)^e, e from 1 to 4."""
        last, first = self.by_last(x), self.by_first(x)
        fourth = sum(np.einsum("nc,nc->n", last[:, r] @ m, first[:, c]) for (r, c), m in zip(self.blocks, weighted[3:], strict=True))
        return [x @ weighted[0], last @ weighted[1], np.einsum("nd,nd->n", last @ weighted[2], x), fourth]


def below(s: float) -> np.ndarray:
    """Coefficients, from the constant on, of (1 + t) h(t); sqrt(1 + t) is no less for any t >= -1."""
    g, d = (lambda t: (1 + t) ** -0.5), (lambda t: -0.5 * (1 + t) ** -1.5)
    odd, slope = (g(s) - g(-s)) / (2 * s), (d(s) + d(-s)) / 2
    h2, h3 = (d(s) - d(-s)) / (4 * s), (slope - odd) / (2 * s * s)
    h = np.array([(g(s) + g(-s)) / 2 - h2 * s * s, odd - h3 * s * s, h2, h3, 0.0])
    return h + np.concatenate([[0.0], h[:-1]])


def _sides(x: np.ndarray, mean: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and a of the module's first lines."""
    w = (x - mean) / spread
    a = ((w * w).sum(1) - 1) / 2
    return np.hstack([-w, np.ones((len(w), 1))]), np.hstack([w, a[:, None]]), a


class Bound:
    """Mean distances from below, of the cells of a label of n cells, from its moments; size is the sum of (1 + |y|)^4."""

    def __init__(self, n: int, size: float, sums: list[np.ndarray], mean: np.ndarray, spread: float):
        d = len(sums[0])
        self.n, self.size, self.mean, self.spread, self.tensor = n, size / n, mean, spread, Tensor(d)
        m, v = sums[0] / n, np.zeros((d, d))
        v[self.tensor.i, self.tensor.j] = v[self.tensor.j, self.tensor.i] = sums[1] / n
        with np.errstate(all="ignore"):
            square = (v[:-1, :-1] ** 2).sum() + 2 * v[-1, -1] - 4 * (m[:-1] * v[:-1, -1]).sum() + 2 * m[-1] ** 2  # mean of t^2 over pairs
            self.c = below(min(max(math.sqrt(max(square, 0.0)), 0.02), 0.9) if np.isfinite(square) else 0.5)
        self.weighted = self.tensor.weighted(sums)

    def of(self, points: np.ndarray) -> np.ndarray:
        x, _, a = _sides(points, self.mean, self.spread)
        with np.errstate(all="ignore"):
            sums = [np.full(len(x), float(self.n)), *self.tensor.powers(self.weighted, x)]
            low = sum(sum(self.c[d] * math.comb(d, e) * a ** (d - e) for d in range(e, 5)) * s for e, s in enumerate(sums))
            # What rounding may change: products of four components, summed in blocks.
            room = 1e-11 * np.abs(self.c).sum() * (1 + np.sqrt((x * x).sum(1)) + np.abs(a)) ** 4 * self.size
            return math.sqrt(2) * self.spread * (low / self.n - room) * (self.n / (self.n - 1))


def _parts(batches, size: int):
    """(g, ids, points) of the rows (cell_id, point, g) of Arrow batches, of about size rows of one g each."""
    held: dict[int, list] = {}

    def joined(g):
        ids, x = zip(*held.pop(g), strict=True)
        return g, np.concatenate(ids), np.concatenate(x)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, of = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for g in np.unique(of).tolist():
            own = of == g
            held.setdefault(g, []).append((ids[own], x[own]))
            if sum(len(i) for i, _ in held[g]) >= size:
                yield joined(g)
        while len(held) > OPEN:
            yield joined(next(iter(held)))
    for g in list(held):
        yield joined(g)


def _in_arrow(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _spreads(rows: DataFrame, n: int) -> tuple[list[np.ndarray], list[float]]:
    """Each label's mean and the root of the mean square distance from it. A task gives a row for each label."""

    def merged(a, b):
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + (gap * gap).sum() * (a[0] * b[0] / n)

    def run(batches):
        got = {}
        for g, _, x in _parts(batches, CELLS):
            mean = x.mean(0)
            own = float(len(x)), mean, ((x - mean) ** 2).sum()
            got[g] = merged(got[g], own) if g in got else own
        yield _in_arrow({"g": pa.array(list(got), pa.int32()), "n": pa.array([v[0] for v in got.values()], pa.float64()), "mean": pa.array([v[1].tolist() for v in got.values()], pa.list_(pa.float64())), "square": pa.array([v[2] for v in got.values()], pa.float64())})

    total = {}
    for r in rows.mapInArrow(run, "g int, n double, mean array<double>, square double").collect():
        own = r.n, np.array(r.mean), r.square
        total[r.g] = merged(total[r.g], own) if r.g in total else own
    spread = [math.sqrt(total[g][2] / total[g][0]) for g in range(n)]
    return [total[g][1] for g in range(n)], [s if s > 0 else 1.0 for s in spread]


def _moments(rows: DataFrame, means: list[np.ndarray], spreads: list[float]) -> str:
    """Folder with a part g=... for each label: rows (order, v), v the bytes of doubles: -1 its cells and size, then the tensor's parts."""

    def run(batches):
        got = {}

        def taken(g):
            parts = got.pop(g)
            for order, v in enumerate(parts, -1):
                yield _in_arrow({"g": pa.array([g], pa.int32()), "order": pa.array([order], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

        for g, _, x in _parts(batches, CELLS):
            _, y, _ = _sides(x, means[g], spreads[g])
            with np.errstate(all="ignore"):
                own = [np.array([len(y), ((1 + np.sqrt((y * y).sum(1))) ** 4).sum()]), *Tensor(y.shape[1]).of(y)]
            if g in got:
                for a, b in zip(got[g], own, strict=True):
                    a += b
            else:
                got[g] = own
            while len(got) > OPEN:
                yield from taken(next(iter(got)))
        for g in list(got):
            yield from taken(g)

    def added(key, own):
        v = np.frombuffer(own["v"].iloc[0]).copy()
        for other in own["v"].iloc[1:]:
            v += np.frombuffer(other)
        return pd.DataFrame({"g": [key[0]], "order": [key[1]], "v": [v.tobytes()]})

    at = f"{shared_dir(rows.sparkSession)}/moments-{uuid.uuid4().hex}"
    rows.mapInArrow(run, "g int, order int, v binary").groupBy("g", "order").applyInPandas(added, "g int, order int, v binary").write.partitionBy("g").parquet(at)
    return at


def _bound(path: str, g: int, mean: np.ndarray, spread: float) -> Bound:
    files, at = fs.FileSystem.from_uri(f"{path}/g={g}")
    names = [f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")]
    got = {order: np.frombuffer(v) for name in names for order, v in zip(*(c.to_pylist() for c in pq.read_table(name, filesystem=files, columns=["order", "v"], partitioning=None).columns), strict=True)}
    d = len(got[0])
    t = Tensor(d)
    size = lambda s: len(range(*s.indices(t.pairs)))
    sums = [got[0], got[1], got[2].reshape(t.pairs, d), *(got[3 + b].reshape(size(r), size(c)) for b, (r, c) in enumerate(t.blocks))]
    return Bound(int(got[-1][0]), got[-1][1], sums, mean, spread)


def of_large(points: DataFrame, label: str, large: list) -> DataFrame:
    """(label, cell_id, m): the cells of the labels `large` that may be medoids, with their mean distances to nine digits."""
    spark = points.sparkSession
    names = F.broadcast(spark.createDataFrame(list(enumerate(large)), f"g int, {label} {dict(points.dtypes)[label]}"))
    rows = points.join(names, label).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("point").cast("array<double>").alias("point"), "g")
    cores = spark.sparkContext.defaultParallelism
    if len(large) > OPEN:  # a task then meets one label after the other
        packed = rows.repartition("g", F.pmod(F.xxhash64("cell_id"), F.lit(max(1, -(-4 * cores // len(large)))))).sortWithinPartitions("g")
    else:  # a task gives moments of every label: few tasks
        packed = rows.coalesce(2 * cores)
    means, spreads = _spreads(packed, len(large))
    path = _moments(packed, means, spreads)

    def bounds(batches):
        known = {}
        for g, ids, x in _parts(batches, CELLS):
            if g not in known:
                while len(known) >= OPEN:
                    known.pop(next(iter(known)))
                known[g] = _bound(path, g, means[g], spreads[g])
            yield _in_arrow({"cell_id": pa.array(ids, pa.int64()), "g": pa.array(np.full(len(ids), g), pa.int32()), "low": pa.array(known[g].of(x), pa.float64())})

    lows = Written(spark, "bounds").put((packed if len(large) > OPEN else rows).mapInArrow(bounds, "cell_id long, g int, low double"))
    # One cell of each label is measured; bounds above its mean distance rule a cell out.
    first = lows.groupBy("g").agg(F.min_by("cell_id", "low").alias("cell_id"))
    tried = {r.g: np.array(r.point) for r in rows.join(F.broadcast(first), ["g", "cell_id"]).collect()}

    def measured(batches):
        got = {}
        for g, _, x in _parts(batches, CELLS):
            got[g] = got.get(g, 0.0) + np.sqrt(((x - tried[g]) ** 2).sum(1)).sum()
        yield _in_arrow({"g": pa.array(list(got), pa.int32()), "s": pa.array(list(got.values()), pa.float64())})

    sizes = lows.groupBy("g").agg(F.count("*").alias("n"))
    limit = rows.mapInArrow(measured, "g int, s double").groupBy("g").agg(F.sum("s").alias("s")).join(sizes, "g").select("g", (F.col("s") / (F.col("n") - 1) * (1 + 1e-9) + 2e-9).alias("limit"))
    ruled_out = (F.col("low") > F.col("limit")) & (F.abs("low") < float("inf"))
    left = lows.join(F.broadcast(limit), "g").where(~F.coalesce(ruled_out, F.lit(False))).select("g", "cell_id")
    # Equal points have equal means: the smallest id stands for them.
    left = rows.join(left, ["g", "cell_id"]).groupBy("g", "point").agg(F.min("cell_id").alias("cell_id"))
    return distance_sums_to(Written(spark, "left").put(left), rows, "g").join(names, "g").select(label, "cell_id", F.round(F.col("s") / F.col("n"), 9).alias("m"))
