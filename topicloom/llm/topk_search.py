"""Operator 4, exact top-k search by inner product: a KD-tree for each shard, searched best-first.

Each vector component x becomes floor(64 x). Queries are the vectors whose id is divisible by QUERY_STEP; candidates are
all others. Median splits of the widest side over a sample of SAMPLE_ROWS vectors cut space into regions of about
SHARD_ROWS vectors; every vector goes to its region, and a region with more is dealt into shards by hash, so that equal
vectors without end share no task. Regions' tight boxes, taken over all their vectors, are sent to all tasks; there are at
most BOX_VALUES / dimension regions. A shard's tree halves its points at the median of the widest side until leaves are small, and
every node keeps the tight box around its points: the largest inner product that a query can have inside a box follows
from the box's ends.

A query goes to regions by falling bound, in rounds: to one, then to two, then to four, and so on. It is sent only where
the bound reaches its kth score so far, which is handed on from round to round, and in a shard visits nodes by falling
bound until the next is below the kth score. Queries travel in blocks of rows, a shard's points are read once a round.

Vectors that are null, empty or hold a null or non-finite component take no part. Inner products are between vectors of
one length only. Rows are told apart by a number of their own: where ids repeat, each row is a candidate, also of other rows
of its id, and each row of a query's id is a query. Null ids take no part. Ties go to the smaller id. An empty table gives
an empty result; other columns are ignored. Scores are exact up to 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices

SCALE, QUERY_STEP, K, SHARD_ROWS, LEAF_ROWS = 64, 20, 20, 8192, 256
#: Vectors that splits are taken from, and values of all regions' lower (or upper) ends, 8 MB.
SAMPLE_ROWS, BOX_VALUES = 16384, 1 << 20


class Splits:
    """Median splits of the widest side of a sample into at most `parts` regions."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.side, self.cut, self.left, self.regions = [], [], [], 0
        self.region, queue = [], [(sample, parts)]
        for points, n in queue:
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
            side = int(np.argmax(spread))
            if n < 2 or spread[side] == 0:
                self._node(-1, 0.0, -1, self.regions)
                self.regions += 1
                continue
            values = points[:, side]
            cut = max(np.median(values), values[values > values.min()].min())
            self._node(side, cut, len(queue), -1)
            queue += [(points[values < cut], n // 2), (points[values >= cut], n - n // 2)]

    def _node(self, *node) -> None:
        for column, x in zip((self.side, self.cut, self.left, self.region), node, strict=True):
            column.append(x)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each point."""
        side, cut, left, at = np.array(self.side), np.array(self.cut), np.array(self.left), np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(side[at] >= 0)).size:
            node = at[inner]
            at[inner] = left[node] + (points[inner, side[node]] >= cut[node])
        return np.array(self.region)[at]


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class BoxTree:
    """A KD-tree over integer points; nodes lie in arrays, children of node i in left[i] and right[i], or -1."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, spans, self.left, self.right, low, high = np.arange(len(points)), [(0, len(points))], [], [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = points[order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            side = int(np.argmax(high[-1] - low[-1]))
            if b - a > leaf_rows and high[-1][side] > low[-1][side]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], mid, kind="introselect")]
                self.left.append(len(spans))
                self.right.append(len(spans) + 1)
                spans += [(a, a + mid), (a + mid, b)]
            else:
                self.left.append(-1)
                self.right.append(-1)
            at += 1
        self.points, self.order, self.spans = points[order], order, spans
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, keys: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best k points but that of key own, all at least `least`; ties to the smaller id, then key."""
        at, best, kth, heap = np.zeros(0, np.int64), np.zeros(0), least, [(-bound[0], 0)]
        while heap:
            negative, node = heapq.heappop(heap)
            if -negative < kth:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            scores = self.points[a:b] @ query
            good = np.flatnonzero(scores >= kth)
            if len(good):
                found = self.order[a:b][good]
                other = keys[found] != own
                at, best = np.concatenate([at, found[other]]), np.concatenate([best, scores[good][other]])
                if len(best) > k:
                    first = np.lexsort((keys[at], ids[at], -best))[:k]
                    at, best = at[first], best[first]
                if len(best) == k:
                    kth = max(kth, best.min())
        first = np.lexsort((keys[at], ids[at], -best))[:k]
        return at[first], best[first]


_ROW = "dim int, region int, shard int, kind int, ids binary, keys binary, points binary, least binary"
_ARROW = pa.schema([*[(n, pa.int32()) for n in ("dim", "region", "shard", "kind")], *[(n, pa.binary()) for n in ("ids", "keys", "points", "least")]])
_SHARD, _QUERIES = 0, 1
_FOUND = ("query_key", "query_id", "vec_id", "vec_key", "score")


def _points(rows: pa.ListArray) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _row(dim, region, shard, kind, ids, keys, points, least) -> dict:
    raw = {"ids": ids.astype("<i8"), "keys": keys.astype("<i8"), "points": points.astype("<f8"), "least": least.astype("<f8")}
    return {"dim": dim, "region": region, "shard": shard, "kind": kind} | {n: x.tobytes() for n, x in raw.items()}


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What blocks of queries find; each shard comes before its blocks."""
    name, tree, ids, keys = None, None, None, None
    for one in slices(batches, 1):
        row = one.to_pylist()[0]
        got_ids, got_keys = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys"))
        points = np.frombuffer(row["points"], "<f8").reshape(len(got_ids), -1)
        if row["kind"] == _SHARD:
            name, tree, ids, keys = (row["dim"], row["region"], row["shard"]), points, got_ids, got_keys
            continue
        if name != (row["dim"], row["region"], row["shard"]):
            raise RuntimeError("a block of queries without its shard")
        if isinstance(tree, np.ndarray):
            tree = BoxTree(tree)
        found = [tree.search(v, b, ids, keys, q, k, m) for v, b, q, m in zip(points, tree.bounds(points), got_keys, np.frombuffer(row["least"], "<f8"), strict=True)]
        at, score = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
        of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (got_keys[of], got_ids[of], ids[at], keys[at], score)], names=list(_FOUND))


def _assigned(whole: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(dim, region, vec_id, key, point) of all vectors, key telling rows apart, and the number of regions of each dimension."""
    whole = materialize(whole.select(F.size("point").alias("dim"), "vec_id", F.monotonically_increasing_id().alias("key"), "point"), "vectors")
    splits = {}
    for r in whole.groupBy("dim").count().collect():
        parts = min(-(-r["count"] // shard_rows), max(1, BOX_VALUES // r.dim))
        sample = whole.where(F.col("dim") == r.dim).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("point").toArrow().column(0).combine_chunks() if parts > 1 else None
        splits[r.dim] = Splits(_points(sample) if parts > 1 else np.zeros((0, r.dim)), parts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, region = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                region[mine] = splits[int(dim)].of(_points(batch.column(3).take(pa.array(mine))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(region), *batch.columns[1:]], names=["dim", "region", "vec_id", "key", "point"])

    rows = whole.mapInArrow(assign, "dim int, region int, vec_id long, key long, point array<double>")
    return materialize(rows, "vector-regions"), {d: s.regions for d, s in splits.items()}


def _boxes(shards: DataFrame, regions: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each dimension the regions' lower and upper ends, and their numbers of shards; none for a region that is empty."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, 1):
            row = one.to_pylist()[0]
            points = np.frombuffer(row["points"], "<f8").reshape(-1, row["dim"])
            n = row["dim"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row[c], np.int32)) for c in ("dim", "region")] + [pa.array(np.arange(n, dtype=np.int32)), pa.array(points.min(0)), pa.array(points.max(0))], names=["dim", "region", "side", "low", "high"])

    got = shards.select("dim", "region", "points").mapInArrow(ends, "dim int, region int, side int, low double, high double").groupBy("dim", "region", "side").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).toPandas()
    boxes = {}
    for dim, n in regions.items():
        own = got[got["dim"] == dim]
        low, high, shard_count = np.zeros((n, dim)), np.zeros((n, dim)), np.zeros(n, np.int64)
        at = own["region"].to_numpy(), own["side"].to_numpy()
        low[at], high[at] = own["low"], own["high"]
        shard_count[at[0]] = own["n"]
        boxes[dim] = low, high, shard_count
    return boxes


def top_k(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP, shard_rows: int = SHARD_ROWS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query."""
    spark = embeddings.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = (
        embeddings.selectExpr("cast(vec_id as long) vec_id", "embedding")
        .where("vec_id is not null and size(embedding) > 0")
        .where(finite)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("point"))
    )
    rows, regions = _assigned(whole, shard_rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, 1):
            got = one.column(3).flatten()
            ids, keys, points = *(got.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key")), _points(got.field("point"))
            yield pa.RecordBatch.from_pylist([_row(*(one.column(c)[0].as_py() for c in range(3)), _SHARD, ids, keys, points, np.zeros(0))], schema=_ARROW)

    shares = rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("shards"))
    dealt = rows.join(F.broadcast(shares), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    shards = materialize(dealt.groupBy("dim", "region", "shard").agg(F.collect_list(F.struct("vec_id", "key", "point")).alias("rows")).mapInArrow(pack, _ROW), "vector-shards")
    boxes = spark.sparkContext.broadcast(_boxes(shards, regions))
    queries = rows.where(F.col("vec_id") % query_step == 0).select("dim", F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), "point")
    best, first, width = None, 0, 1
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "vec_key")
    while first < max(regions.values(), default=1):

        def sent(batches: Iterator[pa.RecordBatch], first=first, width=width) -> Iterator[pa.RecordBatch]:
            """Blocks of queries for the shards of their next regions, by falling bound, that may reach their kth score."""
            for one in slices(batches):
                dims, ids, keys, least = (one.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
                for dim in np.unique(dims):
                    mine = np.flatnonzero(dims == dim)
                    points, (low, high, shard_count) = _points(one.column(3).take(pa.array(mine))), boxes.value[int(dim)]
                    bounds = box_bounds(points, low, high)
                    bounds[:, shard_count == 0] = -np.inf
                    following = np.argsort(-bounds, axis=1, kind="stable")[:, first : first + width]
                    reach = np.take_along_axis(bounds, following, 1) >= least[mine][:, None]
                    for region in np.unique(following[reach]):
                        q = np.flatnonzero(((following == region) & reach).any(1))
                        for shard in range(shard_count[region]):
                            yield pa.RecordBatch.from_pylist([_row(int(dim), int(region), shard, _QUERIES, ids[mine][q], keys[mine][q], points[q], least[mine][q])], schema=_ARROW)

        so_far = queries.withColumn("least", F.lit(float("-inf"))) if best is None else queries.join(best.where(F.col("rank") == k).select("query_key", F.col("score").cast("double").alias("least")), "query_key", "left").select("dim", "query_id", "query_key", "point", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        blocks = materialize(so_far.mapInArrow(sent, _ROW), "query-blocks")
        if blocks.isEmpty():
            break
        there = shards.join(blocks.select("dim", "region", "shard").distinct(), ["dim", "region", "shard"], "left_semi").select(*blocks.columns)
        met = there.unionByName(blocks).repartition("dim", "region", "shard").sortWithinPartitions("dim", "region", "shard", "kind")
        found = met.mapInArrow(lambda batches: _search(batches, k), ", ".join(f"{c} long" for c in _FOUND))
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best-so-far")
        first, width = first + width, 2 * width
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")
