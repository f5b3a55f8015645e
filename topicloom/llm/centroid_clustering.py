"""Operator 11, centroid clustering: block-norm screening.

Vectors become integers, floor(scale * x). Once, before the rounds, each vector is compressed to a code of one byte for a
component (its leading bits, by a shift of the vector's own), and for every segment of SEGMENT components the norm of what
the code leaves over is kept. With x = code + rest, |x - c|^2 = |x|^2 + |c|^2 - 2 code.c - 2 rest.c, and by
Cauchy-Schwarz rest.c is at most the sum over segments of the norms of rest and of c. So codes and norms, an eighth of
the doubles that the components are, give a lower bound of the distance to every centroid. A round takes for each vector the
exact integer distance to the centroid of the lowest bound, and then that of every further centroid whose bound isn't
above it; the others can't be nearer, nor as near, and get none.

A round is one pass over the written vectors. Each task adds up its vectors for each centroid and component; Spark adds
these sums, of which centroids x components reach the driver, and so do the new centroids go out again. Sums and
distances are exact longs. No vector moves between tasks in a round.

Vectors that are null, don't have `dims` components, or hold a null or a non-finite one take no part, nor do those with
a component beyond LARGEST once it is an integer, whose distance wouldn't fit a long. Seeds are the vectors of smallest
sha256 of "<seed>:<vec_id>"; rows that share an id are rows like others and ordered by their vector; rows without id can
be seeds only where too few others are left. With fewer than k vectors there are as many centroids. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

SEGMENT = 8
#: Largest size of a component as an integer: squared distances over 64 of them stay below 2^63.
LARGEST = 1 << 27
#: Vectors that are judged at a time.
ROWS = 4096


class Short(NamedTuple):
    """Compressed vectors: codes as whole numbers, norms of the rest by segment, and squared norms of the vectors."""

    code: np.ndarray
    rest: np.ndarray
    size: np.ndarray


def segment_norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([(x[:, a : a + SEGMENT].astype(np.float64) ** 2).sum(1) for a in range(0, x.shape[1], SEGMENT)], 1))


def compressed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of one byte, by how many bits they are shifted, and the rests' norms by segment, rounded up."""
    bits = np.ceil(np.log2(np.maximum(np.abs(x).max(1), 1) + 1)).astype(np.int64)
    shift = np.maximum(bits - 6, 0)[:, None]
    code = (x + (1 << shift >> 1)) >> shift
    return code.astype(np.int8), shift[:, 0].astype(np.int8), np.nextafter(segment_norms(x - (code << shift)).astype("<f4"), np.float32(np.inf))


def nearest(x: np.ndarray, short: Short, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: the nearest centroid (ties: the first), its squared distance, and how many exact distances were taken."""
    size = short.size[:, None] + (centroids.astype(np.float64) ** 2).sum(1)[None, :]
    # Rounding moves a bound by far less than a billionth of the sizes.
    bound = size * (1 - 1e-9) - 2 * (short.code @ centroids.T.astype(np.float64)) - 2 * (short.rest @ segment_norms(centroids).T) - 1
    rows = np.arange(len(x))
    first = bound.argmin(1)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, first] = ((x - centroids[first]) ** 2).sum(1)
    open_ = bound <= exact[rows, first][:, None]
    open_[rows, first] = False
    for k in range(len(centroids)):
        at = np.flatnonzero(open_[:, k])
        exact[at, k] = ((x[at] - centroids[k]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[rows, best], open_.sum(1) + 1


def packed(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x, code, shift, rest) of the vectors that take part, written once; arrays as little-endian bytes."""
    wide = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    usable = (F.size("embedding") == dims) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) * scale <= LARGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, ROWS):
            x = some.column(1).flatten().to_numpy().reshape(-1, dims)
            code, shift, rest = compressed(x)
            columns = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (x.astype("<i4"), code)]
            yield pa.RecordBatch.from_arrays([some.column(0), *columns, pa.array(shift), pa.array([r.tobytes() for r in rest], pa.binary())], names=["vec_id", "x", "code", "shift", "rest"])

    rows = vectors.where("embedding is not null").where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("x"))
    return materialize(rows.mapInArrow(run, "vec_id long, x binary, code binary, shift byte, rest binary"), "vectors")


def unpacked(some: pa.RecordBatch) -> tuple[np.ndarray, Short]:
    read = lambda c, kind: np.frombuffer(b"".join(some.column(c).to_pylist()), kind).reshape(some.num_rows, -1)
    x, shift = read(1, "<i4").astype(np.int64), some.column(3).to_numpy().astype(np.int64)
    return x, Short(np.ldexp(read(2, np.int8).astype(np.float64), shift[:, None]), read(4, "<f4").astype(np.float64), (x.astype(np.float64) ** 2).sum(1))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first centroids: k rows at most."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.select("x", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), F.hex("x")).limit(k).collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in got], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means; without vectors they stay."""
    spark, shape = rows.sparkSession, centroids.shape
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for some in slices(batches, ROWS):
            x, short = unpacked(some)
            best, _, _ = nearest(x, short, shared.value)
            np.add.at(sums, best, x)
            n += np.bincount(best, minlength=shape[0])
        k, j = np.meshgrid(np.flatnonzero(n), np.arange(shape[1]), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(j.ravel()), pa.array(sums[k.ravel(), j.ravel()]), pa.array(n[k.ravel()])], names=["k", "j", "s", "n"])

    got = rows.mapInArrow(run, "k long, j long, s long, n long").groupBy("k", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in got:
        out[r.k, r.j] = r.s // r.n
    return out


def fit(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of packed rows after so many rounds."""
    centroids = seeds(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, n_exact) of packed rows; n_exact says how many exact distances a row took."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, ROWS):
            best, distance, n = nearest(*unpacked(some), shared.value)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(best.astype(np.int32)), pa.array(distance), pa.array(n.astype(np.int32))], names=["vec_id", "cluster", "distance", "n_exact"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, n_exact int")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, n_exact, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    rows = packed(vectors, dims, scale)
    centroids = fit(rows, k, rounds, seed)
    found = materialize(assign(rows, centroids), "clusters") if len(centroids) else spark.createDataFrame([], "vec_id long, cluster int, distance long, n_exact int")
    totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(i, totals.get(i, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256")


#: The same in DuckDB's SQL: the rounds are a recursion over the centroids, which are lists.
ORACLE_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) p from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c as (select 0 as r, row_number() over (order by sha256('3:' || vec_id)) - 1 as k, p from v order by sha256('3:' || vec_id) limit 8),
w(r, k, p) as (select r, k, p from c union all
  select r, k, coalesce(m, p) from (select w.r + 1 as r, w.k, w.p, n.m from w left join (
    select k, list(m order by i) as m from (select k, i, cast((s - ((s % n) + n) % n) // n as bigint) as m from (
      select k, i, cast(sum(p[i]) as bigint) as s, count(*) as n from (
        select k, p, unnest(range(1, 65)) as i from (
          select v.vec_id, v.p, w.k, row_number() over (partition by v.vec_id order by list_sum(list_transform(list_zip(v.p, w.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), w.k) as o from v, w) where o = 1)
      group by k, i)) group by k) n on n.k = w.k) where r <= 10),
a as (select vec_id, k, d, p from (select v.vec_id, w.k, w.p, cast(list_sum(list_transform(list_zip(v.p, w.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d,
  row_number() over (partition by v.vec_id order by list_sum(list_transform(list_zip(v.p, w.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), w.k) as o from v, w where w.r = 10) where o = 1)
select vec_id, cast(k as integer) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(p, ',')) as centroid_sha256 from a
"""
