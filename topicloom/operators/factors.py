"""Linear embeddings: principal components of points, and latent semantic indexing of counts.

Sums of products over features come from partial sums of batches of rows; only a matrix of features by features, of at
most MAX_FEATURES, meets the driver, and rows are projected where they lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a square on the driver, and the tolerance of the leading values where there are more.
MAX_FEATURES, WIDE_TOLERANCE = 4096, 1e-4


def _bounded(n: int) -> int:
    if n > MAX_FEATURES:
        raise ValueError(f"{n} features; choose at most {MAX_FEATURES}, by variance for instance")
    return n


def _products(rows: DataFrame, matrix, n: int) -> np.ndarray:
    """The sum of x' x over all rows, matrix(batch) being the rows' dense x with n columns."""

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            for a in range(0, len(b), 512):
                x = matrix(b.iloc[a : a + 512])
                total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    got = rows.mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((n, n))
    out[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["s"]
    return out


def _leading(square: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues and their vectors, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(square)
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _moments(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (ddof 1) of the points."""
    first = points.select(F.size("point")).head()
    if first is None:
        raise ValueError("there are no points")
    d = _bounded(first[0])
    s = _products(points.select("point"), lambda b: np.hstack([np.stack(b["point"]).astype(float), np.ones((len(b), 1))]), d + 1)
    n, mean = s[d, d], s[:d, d] / s[d, d]
    return mean, (s[:d, :d] - n * np.outer(mean, mean)) / max(n - 1, 1)


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, cov) of the points' components."""
    _, cov = _moments(points)
    i, j = np.indices(cov.shape)
    return points.sparkSession.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "cov": cov.ravel()}), "i int, j int, cov double")


def pca(points: DataFrame, n: int) -> DataFrame:
    """(cell_id, scores): each point's first n principal components."""
    mean, cov = _moments(points)
    _, vectors = _leading(cov, n)

    def project(batches):
        for b in batches:
            yield pd.DataFrame({"cell_id": b["cell_id"], "scores": list((np.stack(b["point"]).astype(float) - mean) @ vectors)})

    return points.select(F.col("cell_id").cast("long"), "point").mapInPandas(project, "cell_id long, scores array<double>")


def tf_idf(counts: DataFrame, n_cells: int, scale: float = 1e4) -> DataFrame:
    """(cell_id, modality, feature, value): ln(1 + scale x the share) of count x cells / the feature's total, in its cell."""
    totals = counts.groupBy("modality", "feature").agg(F.sum("value").alias("total")).where("total > 0")
    raised = counts.where("value <> 0").join(totals, ["modality", "feature"]).withColumn("value", F.col("value") * n_cells / F.col("total"))
    depth = raised.groupBy("cell_id", "modality").agg(F.sum("value").alias("depth"))
    return raised.join(depth, ["cell_id", "modality"]).select("cell_id", "modality", "feature", F.log1p(F.col("value") / F.col("depth") * scale).alias("value"))


def lsi(counts: DataFrame, features: DataFrame, n_cells: int, n: int) -> DataFrame:
    """(cell_id, scores): left singular vectors of the tf_idf values, each cell's standardised (ddof 1). Cells without counts are left out.

    features: modality, feature and global_idx, which count from 0. More than MAX_FEATURES go to the range finder, which has no
    square of them.
    """
    width = features.count()
    if width > MAX_FEATURES:
        from .range_finder import semantic_index

        return semantic_index(counts, features, n_cells, n, tolerance=WIDE_TOLERANCE)
    entries = tf_idf(counts, n_cells).join(features.select("modality", "feature", "global_idx"), ["modality", "feature"])
    rows = entries.groupBy(F.col("cell_id").cast("long").alias("cell_id")).agg(F.collect_list(F.struct(F.col("global_idx").cast("int").alias("i"), F.col("value").alias("v"))).alias("e")).select("cell_id", F.col("e.i").alias("idx"), F.col("e.v").alias("val"))

    def matrix(b):
        from .inference import dense

        return dense(b, width)

    values, vectors = _leading(_products(rows, matrix, width), n)
    vectors = vectors / np.sqrt(np.maximum(values, 1e-12))

    def project(batches):
        for b in batches:
            u = np.vstack([matrix(b.iloc[a : a + 512]) @ vectors for a in range(0, len(b), 512)])
            u = (u - u.mean(1, keepdims=True)) / np.maximum(u.std(1, ddof=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"cell_id": b["cell_id"], "scores": list(u)})

    return rows.mapInPandas(project, "cell_id long, scores array<double>")
