"""Leading singular vectors of matrices of any width: a randomised range finder over long entries (cell_id, i, value).

A few random combinations of the columns span most of what the leading left vectors span; multiplying by the matrix and
its transpose in turn sharpens that until the values settle. A round reads the cells once, packed in few parts: a task takes
the columns' rows from the shared folder and gives back its part's triangle and sums. Tall tables
(cells or features by a few columns) are orthonormalised by a tree of small QR factorisations, one triangle a task.
The driver sees triangles of (n + extra) squared, never a matrix of cells or of features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Written, stored
from .factors import tf_idf

FAN = 32  # triangles that one task of the tree stacks
PART_ENTRIES, PIECE = 1 << 24, 1 << 16  # entries of a part of cells, and of those multiplied at a time
FLAT = 1e-10  # directions below this share of the largest are dropped


def signs(entries: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(i, y): width random signs for each column, from its number and the seed alone."""
    y = F.array(*[F.when(F.pmod(F.xxhash64("i", F.lit(j), F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0) for j in range(width)])
    return entries.select("i").distinct().select("i", y.alias("y"))


def product(entries: DataFrame, key: str, table: DataFrame, width: int) -> DataFrame:
    """(key, y): for each cell_id or i the sum of value times the row of table under the entry's other name."""
    other = "i" if key == "cell_id" else "cell_id"
    sums = [F.sum(F.col("value") * F.col("y")[j]) for j in range(width)]
    return entries.join(table, other).groupBy(key).agg(F.array(*sums).alias("y"))


def triangle(table: DataFrame, width: int) -> np.ndarray:
    """R of the QR factorisation of a tall table's y, up to signs of its rows; fewer than width rows where the table has."""

    def run(batches):
        r = np.zeros((0, width))
        for b in batches:
            for a in range(0, len(b), 4096):
                r = np.linalg.qr(np.vstack([r, np.stack(b["y"].iloc[a : a + 4096])]), "r")
        if len(r):
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "y": list(r)})

    rows, parts = table.select("y").mapInPandas(run, "part int, y array<double>"), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // FAN)
        # By the part's number, so that a task that runs again sends its triangle to the same place.
        rows = rows.repartition(parts, F.pmod("part", F.lit(parts))).select("y").mapInPandas(run, "part int, y array<double>")
    got = rows.select("y").toPandas()  # triangles of the last level
    return np.linalg.qr(np.stack(got["y"]), "r") if len(got) else np.zeros((0, width))


def turned(table: DataFrame, key: str, matrix: np.ndarray, shift: np.ndarray | float = 0.0) -> DataFrame:
    """(key, y): every row's (y - shift) times the small matrix."""

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "y": list((np.stack(b["y"]) - shift) @ matrix)})

    return table.select(key, "y").mapInPandas(run, f"{key} long, y array<double>")


class Factors:
    """values (descending), left: (cell_id, y), right: (i, y), with X nearly left values right'. Tables lie in the shared folder."""

    def __init__(self, values: np.ndarray, left: DataFrame, right: DataFrame):
        self.values, self.left, self.right = values, left, right


def leading(entries: DataFrame, n: int, extra: int | None = None, tolerance: float = 1e-5, centred: bool = False, seed: int = 0) -> Factors:
    """The n leading singular values and vectors of entries (cell_id, i, value: long, long, double; absent entries are 0).

    Rounds end when no leading value rises by more than tolerance times the largest: values rise towards the true ones
    and never pass them, so this ends. extra columns, 2 n or 10 where it isn't given, speed that up. centred: the columns' means are taken off, over the cells that have entries. Fewer
    than n values come back where the rank is lower; a matrix without non-zero entries is refused, and so are values that
    are not finite; null counts as absent. Each right vector's largest entry is positive.
    """
    spark, width = entries.sparkSession, n + (max(10, 2 * n) if extra is None else extra)
    lefts, rights, sums, products, own = (Written(spark, name) for name in ("left", "right", "sums", "products", "cells"))
    entries = entries.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value")).where("value is not null")
    cells = packed(entries, own)
    means = None
    if centred:
        long = cells.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("i")).agg(F.sum("e.val").alias("value"))
        means = Written(spark, "means").put(long.select("i", (F.col("value") / cells.count()).alias("value")))

    def shift(w: DataFrame) -> np.ndarray:
        """What the means take off each cell's row."""
        row = means.join(w, "i").agg(*[F.sum(F.col("value") * F.col("y")[j]).alias(f"m{j}") for j in range(width)]).head() if centred else []
        return np.array([0.0 if v is None else v for v in row]) if centred else np.zeros(width)

    def parted(r: np.ndarray) -> tuple[np.ndarray, bool]:
        """What makes columns with the triangle r orthonormal, and whether once is enough."""
        if not np.isfinite(r).all():
            raise ValueError("values are not finite")
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        keep = s > FLAT * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
        if not keep.any():
            raise ValueError("every entry is zero")
        return vt[keep].T / s[keep], bool(s[keep][-1] > 1e-5 * s[0])  # one division leaves an error of rounding over this, squared

    w, before = rights.put(signs(cells.select(F.explode("idx").alias("i")), width, seed)), None
    while True:
        for last in (False, True):
            off = shift(w)
            got = sums.put(pass_over(cells, rights.path, off, width))
            turn, fine = parted(triangle(got.where("part is not null"), width))
            if fine or last:
                break
            w, width = rights.put(turned(w, "i", turn)), turn.shape[1]
        z = got.where("part is null").groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(width)]).alias("y"))
        z, at, spread = products.put(turned(z, "i", turn)), rights.path, turn
        _, s, vt = np.linalg.svd(triangle(z, turn.shape[1]), full_matrices=False)
        kept = min(n, int((s > FLAT * s[0]).sum()))
        if before is not None and len(before) == kept and np.abs(s[:kept] - before).max() <= tolerance * s[0]:
            break
        before, width = s[:kept], turn.shape[1]
        w = z
        for _ in range(2):
            turn, fine = parted(triangle(w, width))
            w, width = turned(w, "i", turn), turn.shape[1]
            if fine:
                break
        w = rights.put(w)
    largest = turned(z, "i", vt[:kept].T / s[:kept]).agg(*[F.max_by(F.col("y")[j], F.abs(F.col("y")[j])).alias(f"m{j}") for j in range(kept)]).head()
    turn = vt[:kept].T * np.where(np.array(list(largest)) < 0, -1.0, 1.0)
    left = lefts.put(rows_of(cells, at, off, spread @ turn))
    return Factors(s[:kept], left, Written(spark, "right").put(turned(z, "i", turn / s[:kept])))


def packed(entries: DataFrame, to: Written) -> DataFrame:
    """(cell_id, idx, val): a row for each cell, in few large parts, as each part's sums have a row for each column."""
    spark, n = entries.sparkSession, Written(entries.sparkSession, "entries").put(entries)
    parts = max(spark.sparkContext.defaultParallelism, -(-n.count() // PART_ENTRIES))
    rows = n.repartition(parts, "cell_id").groupBy("cell_id").agg(F.collect_list(F.struct("i", "value")).alias("e"))
    return to.put(rows.select("cell_id", F.col("e.i").alias("idx"), F.col("e.value").alias("val"))).coalesce(parts)


def _products(path: str, off: np.ndarray):
    """What gives, for a batch of cells, their entries in pieces (batch rows, starts, places, values) with X w - off, and w's columns."""
    ids, w = stored(path, len(off))

    def pieces(b: pd.DataFrame):
        sizes = np.array([len(v) for v in b["idx"]])
        ends = np.cumsum(sizes)
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            place = np.searchsorted(ids, np.concatenate(list(b["idx"].iloc[at:to])))
            val = np.concatenate(list(b["val"].iloc[at:to])).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes[at:to])[:-1]])
            yield slice(at, to), np.repeat(np.arange(to - at), sizes[at:to]), place, val, np.add.reduceat(val[:, None] * w[place], starts, axis=0) - off
            at = to

    return ids, pieces


def pass_over(cells: DataFrame, path: str, off: np.ndarray, width: int) -> DataFrame:
    """One reading of the cells: the triangle of y = X w - off (part, y), and X' y (i, y) summed within a part; w lies at path."""

    def run(batches):
        r, made = np.zeros((0, width)), None
        for b in batches:
            if made is None:
                ids, pieces = made = _products(path, off)
                total, met = np.zeros((len(ids), width)), np.zeros(len(ids), bool)
            for _, row, place, val, y in pieces(b):
                for a in range(0, len(y), 4096):
                    r = np.linalg.qr(np.vstack([r, y[a : a + 4096]]), "r")
                order = np.argsort(place, kind="stable")
                place, first = np.unique(place[order], return_index=True)
                total[place] += np.add.reduceat(val[order, None] * y[row[order]], first, axis=0)
                met[place] = True
        if made is not None:
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "i": None, "y": list(r)})
            at = np.flatnonzero(met)
            for a in range(0, len(at), 4096):
                yield pd.DataFrame({"part": None, "i": ids[at[a : a + 4096]], "y": list(total[at[a : a + 4096]])})

    return cells.mapInPandas(run, "part int, i long, y array<double>")


def rows_of(cells: DataFrame, path: str, off: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(cell_id, y): every cell's row of (X w - off) turn."""

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or _products(path, off)[1]
            for at, *_, y in pieces(b):
                yield pd.DataFrame({"cell_id": b["cell_id"].iloc[at].to_numpy(), "y": list(y @ turn)})

    return cells.mapInPandas(run, "cell_id long, y array<double>")


def principal_components(points: DataFrame, n: int, **options) -> DataFrame:
    """(cell_id, scores): each point's first n principal components, for points of any length. Empty points are left out."""
    got = leading(points.select("cell_id", F.posexplode("point").alias("i", "value")), n, centred=True, **options)
    return got.left.select("cell_id", F.array(*[F.col("y")[j] * float(v) for j, v in enumerate(got.values)]).alias("scores"))


def semantic_index(counts: DataFrame, features: DataFrame, n_cells: int, n: int, **options) -> DataFrame:
    """(cell_id, scores) as factors.lsi, for any number of features."""
    entries = tf_idf(counts, n_cells).join(features.select("modality", "feature", F.col("global_idx").alias("i")), ["modality", "feature"])

    def run(batches):
        for b in batches:
            if len(b):
                u = np.stack(b["y"])
                u = (u - u.mean(1, keepdims=True)) / np.maximum(u.std(1, ddof=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"cell_id": b["cell_id"], "scores": list(u)})

    return leading(entries.select("cell_id", "i", "value"), n, **options).left.mapInPandas(run, "cell_id long, scores array<double>")
