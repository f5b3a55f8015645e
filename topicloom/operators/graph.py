"""Graphs as edges (src, dst, weight): normalisation, propagation, neighbourhoods, trees and spatial statistics."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed, in_buckets, written

#: Values of a block of points, blocks that points of some number make at least, pairs of points held at a time, others and pairs that
#: are screened at a time, and edges up to which a tree is walked on the driver.
BLOCK_VALUES, LEAST_BLOCKS, PAIRS, STRIP, TILE, DRIVER_EDGES = 1 << 20, 8, 1 << 21, 4096, 1 << 20, 500_000


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0).alias("weight"))
    return edges.select("src", "dst", "weight").unionByName(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def gcn_normalised(edges: DataFrame, nodes: DataFrame, extra: float = 0.0) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 with D the degrees of A + I plus extra; degrees of 0 count as 1."""
    a = with_self_loops(edges, nodes)
    d = a.groupBy("src").agg((F.sum("weight") + extra).alias("d")).select("src", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("d"))
    rows = a.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return rows.select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def propagate(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """One sparse product: values (cell_id, feature, value). A cell's values travel along its edges as one row, bounded by the features."""
    packed = values.groupBy(F.col("cell_id").alias("dst")).agg(F.collect_list(F.struct("feature", "value")).alias("e"))
    # Moved once by src; the sums below stay where their rows are.
    sent = matrix.join(packed, "dst").select(F.col("src").alias("cell_id"), "weight", "e").repartition("cell_id")
    return sent.select("cell_id", "weight", F.explode("e").alias("e")).groupBy("cell_id", F.col("e.feature").alias("feature")).agg(F.sum(F.col("weight") * F.col("e.value")).alias("value"))


def sgc(counts: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1, keep_all: bool = True) -> DataFrame:
    """(cell_id, feature, hop, value): ln(1 + x) of counts scaled to the lower median depth and smoothed 0..hops times."""
    lib = counts.groupBy("cell_id").agg(F.sum("value").alias("lib"))
    lib = nodes.select("cell_id").join(lib, "cell_id", "left").select("cell_id", F.coalesce("lib", F.lit(0.0)).alias("lib"))
    mid = lib.agg(F.expr("percentile_disc(0.5) within group (order by lib)").alias("mid"))
    x = counts.join(lib, "cell_id").join(F.broadcast(mid)).select("cell_id", "feature", (F.col("value") / F.greatest("lib", F.lit(1.0)) * F.col("mid")).alias("value"))
    matrix = gcn_normalised(edges, nodes, extra=1.0)  # degrees of A plus 2
    out = None
    for hop in range(hops + 1):
        if hop:
            x = propagate(matrix, x)
        now = x.select("cell_id", "feature", F.lit(hop).alias("hop"), F.log1p("value").alias("value"))
        out = now if out is None or not keep_all else out.unionByName(now)
    return out


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(cell_id, hop): cells within hops steps of the seeds, with the smallest number of steps."""
    reached = seeds.select("cell_id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = edges.join(reached.where(F.col("hop") == hop - 1).select(F.col("cell_id").alias("src")), "src").select(F.col("dst").alias("cell_id")).distinct()
        reached = reached.unionByName(step.join(reached.select("cell_id"), "cell_id", "left_anti").withColumn("hop", F.lit(hop)))
    return reached


def sampled_neighbours(edges: DataFrame, seeds: DataFrame, fan_outs: list[int], seed: int = 0) -> DataFrame:
    """(hop, src, dst): at most fan_out neighbours of each frontier cell, in the order of md5 of `src,dst,seed,hop`."""
    frontier, out = seeds.select("cell_id").distinct(), None
    for hop, n in enumerate(fan_outs, 1):
        order = Window.partitionBy("src").orderBy(F.md5(F.concat_ws(",", "src", "dst", F.lit(seed), F.lit(hop))), "dst")
        took = edges.join(frontier.select(F.col("cell_id").alias("src")), "src").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select(F.lit(hop).alias("hop"), "src", "dst")
        out = took if out is None else out.unionByName(took)
        frontier = took.select(F.col("dst").alias("cell_id")).distinct()
    return out


def blocked(points: DataFrame, columns: list[str], within: str | None = None) -> tuple[DataFrame, int]:
    """(block, b) and the number of blocks: all points packed into hashed blocks of about BLOCK_VALUES values each, smaller where
    there would be few.

    b holds arrays: ids, points one after the other, and the columns. cell_id is unique, so that hashing fills blocks evenly.
    With within, a block holds points of one value of that column, which is a column of the result (own).
    """
    group = [F.col(within).alias("own")] if within else []
    sizes = points.groupBy(*group).agg(F.count("*").alias("n"), F.max(F.size("point")).alias("width"))
    n, width = sizes.agg(F.max("n"), F.max("width")).head()
    values = (n or 0) * (width or 1)
    blocks = max(1, -(-values // BLOCK_VALUES), min(LEAST_BLOCKS, -(-values // max(1, BLOCK_VALUES >> 7))))
    rows = F.sort_array(F.collect_list(F.struct("cell_id", "point", *columns)))
    packed = points.groupBy(F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int").alias("block"), *group).agg(rows.alias("r"))
    each = lambda c: F.transform("r", lambda e: e[c])
    return packed.select("block", *(["own"] if within else []), F.struct(each("cell_id").alias("ids"), F.flatten(each("point")).alias("points"), *[each(c).alias(c) for c in columns]).alias("b")), blocks


def against(points: DataFrame, others: DataFrame, columns: list[str], score, schema: str, half: bool = False, within: str | None = None, scan=None) -> DataFrame:
    """The frames that score(a, b, same) gives for every block of points and every block of others, in one result.

    scan(pairs), where it is given in place of score, gets all (a, b, same) of a task; those of one block of others follow one another
    where the join sorts.

    A block is a dict of ids, points (one row each) and the columns. Blocks of points are sent to each block of others by a join on
    its number, inside Spark: the work is quadratic by definition, but no pair of points is a row, and no point passes
    through the driver. With half, others are the points, and of two blocks each pair comes once; same tells a block that meets
    itself. With within, only blocks of one value of that column meet.
    """
    spark, name = points.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(16 << 20))  # a row holds two blocks
    left, m = blocked(points, columns, within)
    left = checkpointed(left)
    right, n = (left, m) if half else blocked(others, columns, within)
    # Copies of a block of others are dealt out, so that few blocks make enough tasks.
    deals = max(1, -(-4 * spark.sparkContext.defaultParallelism // n))
    own = ["own"] if within else []
    first = F.col("block") if half else F.lit(0)
    sent = left.select(F.col("b").alias("a"), F.col("block").alias("at"), F.pmod(F.col("block"), F.lit(deals)).alias("deal"), *own, F.explode(F.sequence(first, F.lit(n - 1))).alias("block"))
    dealt = (right if half else checkpointed(right)).select("block", "b", *own, F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    fields = ["ids", "points", *columns]
    pairs = sent.join(dealt, ["block", "deal", *own]).select((F.col("at") == F.col("block")).alias("same"), *[F.col(side)[c].alias(f"{side}_{i}") for side in "ab" for i, c in enumerate(fields)])

    def opened(row) -> dict:
        x = dict(zip(fields, map(np.asarray, row), strict=True))
        return x | {"points": x["points"].astype(np.float64).reshape(len(x["ids"]), -1)}

    def run(batches):
        met = ((opened(row[: len(fields)]), opened(row[len(fields) :]), same) for batch in batches for same, *row in batch.itertuples(index=False, name=None))
        if scan:
            yield from scan(met)
        else:
            for pair in met:
                yield from score(*pair)

    return pairs.mapInPandas(run, schema)


def _parts(a: np.ndarray, b: np.ndarray) -> list[slice]:
    """Slices of a whose pairs with b are at most PAIRS."""
    step = max(1, PAIRS // max(1, len(b)))
    return [slice(i, i + step) for i in range(0, len(a), step)]


def _of_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a[i] and b[j], straight from the definition."""
    out, step = np.empty(len(i)), max(1, PAIRS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        x, y = a[i[s : s + step]], b[j[s : s + step]]
        if metric == "cosine":
            out[s : s + step] = 1 - (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        else:
            out[s : s + step] = np.sqrt(((x - y) ** 2).sum(1))
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a product of matrices; those of close points, which it would blur, from the definition."""
    na, nb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    d = a @ b.T
    d *= -2
    d += na
    d += nb
    i, j = np.nonzero(~(d > 1e-5 * (na + nb)))
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    d[i, j] = _of_pairs(a, b, i, j, "euclidean")
    return d


def _nearest(a: np.ndarray, b: np.ndarray, k: int, metric: str, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of all pairs that may be among the k nearest of a[i] by distances to nine digits; apart marks pairs to leave out.

    A product of matrices in single precision bounds each distance from both sides; what its bounds leave is measured.
    """
    with np.errstate(all="ignore"):
        if metric == "cosine":
            x, y = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (a, b))
            na, nb = np.full(len(a), 0.5), np.full(len(b), 0.5)
            scale = 1.0
        else:
            x, y, na, nb, scale = a, b, (a * a).sum(1), (b * b).sum(1), 2.0
        single = max(na.max(initial=0), nb.max(initial=0)) < 1e30 and a.shape[1] <= 1024
        kind, slack = (np.float32, 1e-4) if single else (np.float64, 1e-12 * max(1, a.shape[1] // 1024))
        room = (slack * na).astype(kind)[:, None] + (slack * nb).astype(kind)[None, :]
        top = x.astype(kind) @ y.astype(kind).T  # x and y are within bounds of kind
        top *= kind(-scale)
        top += na.astype(kind)[:, None]
        top += nb.astype(kind)[None, :]
        top += room  # no less than the (squared) distance
        top[np.isnan(top)] = np.inf
        if apart is not None:
            top[apart] = np.inf
        m = min(k, len(b)) - 1
        kth = np.partition(top, m, axis=1)[:, m].astype(np.float64)
        limit = kth + 3e-9 if metric == "cosine" else (np.sqrt(np.maximum(kth, 0)) + 3e-9) ** 2
        room *= 2
        top -= room
        i, j = np.nonzero((top <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]) & (top < np.inf))
        return i, j, _of_pairs(a, b, i, j, metric)


class Nearest:
    """The k nearest of the points x to any others that were met, by distances to nine digits, ties by id.

    A first strip of others bounds each point's distances; from then on one product in single precision and one comparison leave
    a point those others that may be nearer than its k-th so far, and only these are measured and merged.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.ids, self.x, self.k, self.metric = ids, x, k, metric
        self.d, self.to = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        self.middle = x.mean(0) if metric == "euclidean" and len(x) and np.isfinite(x).all() else np.zeros(x.shape[1])

    def _keep(self, i: np.ndarray, d: np.ndarray, to: np.ndarray) -> None:
        """Pairs of the points i, which rise, are merged into what is known."""
        fine = np.isfinite(d) & (to != self.ids[i])
        i, d, to = i[fine], d[fine], to[fine]
        rows = np.unique(i)
        i, d, to = np.concatenate([np.repeat(rows, self.k), i]), np.concatenate([self.d[rows].ravel(), d]), np.concatenate([self.to[rows].ravel(), to])
        order = np.lexsort((to, np.round(d, 9), i))
        i, d, to = i[order], d[order], to[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        few = rank < self.k
        self.d[i[few], rank[few]], self.to[i[few], rank[few]] = d[few], to[few]

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        first = min(len(y), max(STRIP // 8, 4 * self.k)) if np.isinf(self.d[:, -1]).any() else 0
        for part in _parts(self.ids, ids[:first]) if first else []:
            apart = self.ids[part][:, None] == ids[None, :first] if np.isin(self.ids[part], ids[:first]).any() else None
            i, j, d = _nearest(self.x[part], y[:first], self.k, self.metric, apart)
            self._keep(i + part.start, d, ids[j])
        for a in range(first, len(y), STRIP):
            self._meet(ids[a : a + STRIP], y[a : a + STRIP])

    def _meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            near = self.metric == "euclidean"
            u, v = (p - self.middle if near else p / np.sqrt((p * p).sum(1, keepdims=True)) for p in (self.x, y))
            nu, nv = ((p * p).sum(1) if near else np.full(len(p), 0.5) for p in (u, v))
            single = max(nu.max(initial=0), nv.max(initial=0)) < 1e30 and u.shape[1] <= 1024
            kind, slack = (np.float32, (u.shape[1] + 16) * 2.0**-22) if single else (np.float64, 1e-12 * max(1, u.shape[1] // 1024))
            # What taking the middle off may change in a distance, and rounding to nine digits.
            blur = 3e-9 + (2.0**-48 * np.sqrt(max((self.x**2).sum(1).max(initial=0), (y * y).sum(1).max(initial=0))) if near else 0.0)
            left = np.hstack([(-2.0 if near else -1.0) * u, np.ones((len(u), 1))]).astype(kind)
            right = np.vstack([v.T, (nv * (1 - slack))[None, :]]).astype(kind)
            step, kept, waiting = max(1, TILE // max(1, len(y))), [], 0
            tile = np.empty((min(step, len(u)), len(y)), kind)
            for a in range(0, len(u), step):
                kth = self.d[a : a + step, -1] + blur
                limit = (kth * kth if near else kth) - nu[a : a + step] * (1 - slack)
                scores = np.matmul(left[a : a + step], right, out=tile[: len(limit)])
                i, j = np.divmod(np.flatnonzero(scores <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]), len(y))
                kept.append((i + a, j))
                waiting += len(i)
                if waiting > PAIRS >> 2 or a + step >= len(u):
                    i, j = (np.concatenate(c) for c in zip(*kept, strict=True))
                    self._keep(i, _of_pairs(self.x, y, i, j, self.metric), ids[j])
                    kept, waiting = [], 0

    def frame(self) -> pd.DataFrame:
        i, r = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"src": self.ids[i], "dst": self.to[i, r], "distance": self.d[i, r]})


def knn(points: DataFrame, k: int, metric: str = "euclidean", candidates: DataFrame | None = None) -> DataFrame:
    """(src, rank, dst, distance): the nearest of candidates (or of the points) but itself, ties by id. points: cell_id, point."""

    def scan(pairs):
        now = None
        for others, block, _ in pairs:
            if now is None or not np.array_equal(now.ids, block["ids"]):
                if now:
                    yield now.frame()
                now = Nearest(block["ids"], block["points"], k, metric)
            now.meet(others["ids"], others["points"])
        if now:
            yield now.frame()

    # Blocks of candidates are sent to those of points, which keep what is nearest so far.
    found = against(points if candidates is None else candidates, points, [], None, "src long, dst long, distance double", scan=scan)
    order = Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "rank", "dst", "distance")


def distance_sums(points: DataFrame, label: str, own: bool = False) -> DataFrame:
    """(cell_id, own, label, s, n): for each cell and label the sum of distances to its other cells, and their number.

    With own, a cell's own label alone; cells of different labels don't meet then.
    """

    def sums(a, b, same):
        (ka, la), (kb, lb) = (np.unique(x[label], return_inverse=True) for x in (a, b))
        of_a, of_b = np.eye(len(ka))[la], np.eye(len(kb))[lb]
        sa, sb = np.zeros((len(la), len(kb))), np.zeros((len(lb), len(ka)))
        na = np.tile(of_b.sum(0), (len(la), 1))
        for part in _parts(a["ids"], b["ids"]):
            d = _distances(a["points"][part], b["points"])
            if same:
                alike = a["ids"][part][:, None] == b["ids"][None, :]
                d[alike] = 0.0
                na[part] -= alike @ of_b
            else:
                sb += d.T @ of_a[part]
            sa[part] = d @ of_b
        yield _sum_rows(a, label, kb, sa, na)
        if not same:
            yield _sum_rows(b, label, ka, sb, np.tile(of_a.sum(0), (len(lb), 1)))

    kind = dict(points.dtypes)[label]
    found = against(points, points, [label], sums, f"cell_id long, own {kind}, label {kind}, s double, n long", half=True, within=label if own else None)
    return found.groupBy("cell_id", "own", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")


def distance_sums_to(points: DataFrame, others: DataFrame, label: str) -> DataFrame:
    """(cell_id, label, s, n): for each of the points the sum of distances to the others of its label but itself, and their number."""

    def sums(a, b, _):
        for part in _parts(a["ids"], b["ids"]):
            ids, d = a["ids"][part], _distances(a["points"][part], b["points"])
            alike = ids[:, None] == b["ids"][None, :]
            d[alike] = 0.0
            yield pd.DataFrame({"cell_id": ids, label: a[label][part], "s": d.sum(1), "n": len(b["ids"]) - alike.sum(1)})

    found = against(points, others, [label], sums, f"cell_id long, {label} {dict(points.dtypes)[label]}, s double, n long", within=label)
    return found.groupBy("cell_id", label).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")


def _sum_rows(x: dict, label: str, kinds: np.ndarray, s: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    ids = x["ids"]
    return pd.DataFrame({"cell_id": np.repeat(ids, len(kinds)), "own": np.repeat(x[label], len(kinds)), "label": np.tile(kinds, len(ids)), "s": s.ravel(), "n": n.ravel().astype(np.int64)})


def coo(adjacency: DataFrame) -> DataFrame:
    """(row, col, weight) of an adjacency with one row for each cell: cell_id, and neighbours as an array of (dst, weight)."""
    return adjacency.select(F.col("cell_id").alias("row"), F.explode("neighbours").alias("e")).select("row", F.col("e.dst").alias("col"), F.col("e.weight").alias("weight")).where("weight <> 0")


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(feature, i): values (cell_id, feature, value) has every cell; 0 where the weights or the variance add up to 0."""
    m = values.groupBy("feature").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    z = values.join(m, "feature").select("cell_id", "feature", "n", (F.col("value") - F.col("m")).alias("z"))
    s0 = edges.agg(F.sum("weight").alias("s0"))
    down = z.groupBy("feature").agg(F.sum(F.col("z") * F.col("z")).alias("down"), F.max("n").alias("n"))
    far = z.select(F.col("cell_id").alias("dst"), "feature", F.col("z").alias("zb"))
    up = edges.join(z.select(F.col("cell_id").alias("src"), "feature", "z"), "src").join(far, ["dst", "feature"]).groupBy("feature").agg(F.sum(F.col("weight") * F.col("z") * F.col("zb")).alias("up"))
    rows = down.join(up, "feature", "left").join(F.broadcast(s0))
    safe = (F.col("down") > 0) & (F.col("s0") != 0)
    return rows.select("feature", F.when(safe, F.col("n") / F.col("s0") * F.coalesce("up", F.lit(0.0)) / F.col("down")).otherwise(0.0).alias("i"))


def _lightest(rows: pa.Table) -> pa.Table:
    """Of rows (ca, cb, a, b, weight) the edges (a, b, weight) that join components, lightest first, ties by their ends."""
    order = np.lexsort([rows[c].to_numpy() for c in ("b", "a", "weight")])
    components, at = np.unique(np.concatenate([rows["ca"].to_numpy(), rows["cb"].to_numpy()]), return_inverse=True)
    parent, taken = np.arange(len(components)), np.zeros(len(order), bool)

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for r in order:
        x, y = root(at[r]), root(at[r + len(order)])
        if x != y:
            parent[x], taken[r] = y, True
    return rows.select(["a", "b", "weight"]).take(order[taken[order]])


def spanning_tree(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(a, b, weight): a minimum spanning forest of undirected edges; of several between two cells the heaviest counts.

    While more than driver_edges edges run between components, each component takes its lightest edge out (ties by its
    ends) in a round of joins, which halves them at least. The bounded rest is joined on the driver. The order of edges is
    total, so that both give the same forest.
    """
    spark = edges.sparkSession
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    across = written(e.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b", "weight"))
    tree = None
    while across.count() > driver_edges:
        key = F.struct("weight", "a", "b").alias("e")
        ends = across.select(F.col("ca").alias("c"), key).unionByName(across.select(F.col("cb").alias("c"), key))
        best = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct().select("a", "b", "weight"))
        tree = best if tree is None else tree.unionByName(best)
        links = across.join(best.select("a", "b"), ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        nodes = across.select(F.col("ca").alias("v")).union(across.select("cb")).distinct()
        label = min_labels(written(nodes.select("v", F.col("v").alias("c"))), written(links))
        la, lb = label.withColumnsRenamed({"v": "ca", "c": "na"}), label.withColumnsRenamed({"v": "cb", "c": "nb"})
        across = written(across.join(la, "ca").join(lb, "cb").where("na <> nb").select(F.col("na").alias("ca"), F.col("nb").alias("cb"), "a", "b", "weight"))
    rest = spark.createDataFrame(_lightest(across.toArrow()), e.schema)  # arrays of driver_edges numbers
    return rest if tree is None else tree.unionByName(rest)


def min_labels(label: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels (v, c) after joining the components at both ends of each link."""
    while True:
        la, lb = label.withColumnsRenamed({"v": "a", "c": "ca"}), label.withColumnsRenamed({"v": "b", "c": "cb"})
        low = links.join(la, "a").join(lb, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("to")).groupBy("c").agg(F.min("to").alias("to"))
        low = written(low)
        if not low.limit(1).count():
            return label
        label = written(label.join(low, "c", "left").select("v", F.coalesce("to", "c").alias("c")))


def shortest_paths(edges: DataFrame, root: int, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(cell_id, distance) from root over undirected edges of no negative weight.

    Up to driver_edges edges are walked on the driver, nearest cell first. Of more, cells with a single neighbour are taken off first,
    in rounds, as no path leads through them: they are as far as it and their edge. Where a round takes off less than a tenth of the edges, the
    rest is relaxed in Spark, in as many rounds as the longest shortest path has edges. All give the same.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = written(both.where("src <> dst or weight < 0").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    if not both.where("weight < 0").isEmpty():
        raise ValueError("edges have negative weights")
    ends, n = [], both.count()
    while n > 2 * driver_edges:
        last = both.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst"), F.first("weight").alias("weight")).where((F.col("n") == 1) & (F.col("src") != root))
        # Of two cells that have only each other neither is reached.
        last = written(last.select("src", "dst", "weight"))
        off = last.select("src")
        fewer = written(both.join(off, "src", "left_anti").join(off.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst", "weight"))
        before, n = n, fewer.count()
        ends.append(last)
        both = fewer
        if n > 0.9 * before:
            break
    known = _walked(both.toArrow(), both, root) if n <= 2 * driver_edges else _relaxed(both, root)
    for last in reversed(ends):
        far = last.join(known.withColumnRenamed("cell_id", "dst"), "dst").select(F.col("src").alias("cell_id"), (F.col("distance") + F.col("weight")).alias("distance"))
        known = written(known.unionByName(far))
    return known


def _walked(rows: pa.Table, both: DataFrame, root: int) -> DataFrame:
    """Distances over edges (src, dst, weight) that go both ways, on the driver."""
    src, dst, weight = (rows[c].to_numpy() for c in ("src", "dst", "weight"))
    order = np.argsort(src, kind="stable")
    cells = np.union1d(src, [root]).astype(np.int64)
    first = np.searchsorted(src[order], np.append(cells, np.iinfo(np.int64).max))
    to, weight = np.searchsorted(cells, dst[order]), weight[order]
    far, done = np.full(len(cells), np.inf), np.zeros(len(cells), bool)
    begin = int(np.searchsorted(cells, root))
    far[begin], heap = 0.0, [(0.0, begin)]
    while heap:
        d, cell = heapq.heappop(heap)
        if not done[cell]:
            done[cell] = True
            e = slice(first[cell], first[cell + 1])
            for other, w in zip(to[e].tolist(), weight[e].tolist(), strict=True):
                if d + w < far[other]:
                    far[other] = d + w
                    heapq.heappush(heap, (d + w, other))
    return both.sparkSession.createDataFrame(pa.table({"cell_id": cells[done], "distance": far[done]}), "cell_id long, distance double")


def _relaxed(both: DataFrame, root: int) -> DataFrame:
    known = both.sparkSession.createDataFrame([(root, 0.0)], "cell_id long, distance double")
    front = known
    while True:
        step = front.join(both.withColumnRenamed("src", "cell_id"), "cell_id").groupBy(F.col("dst").alias("cell_id")).agg(F.min(F.col("distance") + F.col("weight")).alias("d"))
        front = written(step.join(known, "cell_id", "left").where("distance is null or d < distance").select("cell_id", F.col("d").alias("distance")))
        if front.isEmpty():
            return known
        known = written(known.join(front.select("cell_id"), "cell_id", "left_anti").unionByName(front))


def label_propagation(edges: DataFrame) -> DataFrame:
    """(cell_id, community): each cell takes the label that weighs most among its neighbours and itself, ties to the smaller.

    In a round half of the cells vote, by a hash of cell and round, so that neighbours don't change places for ever; it
    ends when no cell of all would change. Only neighbours of cells that changed are asked anew, as others would answer the same.
    """
    both = written(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    own = both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    links = in_buckets(both.unionByName(own), "src", "links")

    def asked(links: DataFrame, labels: DataFrame) -> DataFrame:
        votes = links.join(labels.select(F.col("cell_id").alias("dst"), "community"), "dst").repartition("src").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        return votes.groupBy("src").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("community")).alias("c"))).alias("m")).select(F.col("src").alias("cell_id"), (-F.col("m.c")).alias("to"))

    labels, turn = links.where("src = dst").select(F.col("src").alias("cell_id"), F.col("src").alias("community")), 0
    met = written(labels.join(asked(links, labels), "cell_id"))
    while not met.where("community <> to").isEmpty():
        turn += 1
        half = F.pmod(F.xxhash64("cell_id", F.lit(turn)), F.lit(2)) == 0
        moved = met.where(half & (F.col("community") != F.col("to"))).select(F.col("cell_id").alias("src"))
        if moved.isEmpty():
            continue
        labels = met.select("cell_id", F.when(half, F.col("to")).otherwise(F.col("community")).alias("community"), "to")
        # Links run both ways, and from a cell to itself.
        near = links.join(moved, "src", "left_semi").select(F.col("dst").alias("src")).distinct()
        new = asked(links.join(near, "src", "left_semi"), labels).withColumnRenamed("to", "now")
        met = written(labels.join(new, "cell_id", "left").select("cell_id", "community", F.coalesce("now", "to").alias("to")))
    return met.select("cell_id", "community")
