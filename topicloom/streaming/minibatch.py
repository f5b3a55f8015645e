"""Mini-batch variational updates over a stream of cells, by foreachBatch: an extension.

The parameters are the stream's state. After each batch they are written to the state's folder under the batch's number,
and a new start goes on from the last one there; a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import np_digamma
from ..operators import kernels as K
from ..operators.inference import generator, sparse


class StreamingTopics:
    """update() takes each batch of (cell_id, idx, val). Rates of n_features features follow gamma distributions with shape a
    and rate b; a batch's sums are scaled to n_cells, the corpus's expected size, and move them by a decreasing step."""

    def __init__(self, spark: SparkSession, path: str, n_features: int, n_topics: int, n_cells: int, alpha: float = 0.1, kappa: float = 0.6, tau0: float = 1.0, inner_iters: int = 3, seed: int = 0):
        self.spark, self.path, self.n_cells, self.alpha, self.kappa, self.tau0, self.inner_iters = spark, path.rstrip("/"), n_cells, alpha, kappa, tau0, inner_iters
        self.a, self.b = generator(seed, 0, 1).gamma(1.0, size=(n_features, n_topics)) + 0.1, np.ones((n_features, n_topics))
        self.step, self.last = 0, -1
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName()) for f in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if files.exists(folder) else []
        if done:
            row = spark.read.parquet(f"{self.path}/{max(done)}").head()
            self.last, self.step = max(done), row.step
            self.a, self.b = (np.frombuffer(bytes(x)).reshape(n_features, n_topics).copy() for x in (row.a, row.b))

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        a, b, alpha, inner = self.a, self.b, self.alpha, self.inner_iters
        e_log, e_rate = np_digamma(a) - np.log(b), a / b

        def run(frames):
            total, cells = np.zeros((len(a) + 1, a.shape[1])), 0
            for f in frames:
                x = sparse(f)
                gamma = np.full((len(f), a.shape[1]), alpha + 1.0)
                for _ in range(inner):
                    n, m = K.svem_estep_poisson(x, np_digamma(gamma) - np_digamma(gamma.sum(1, keepdims=True)), e_log, e_rate)
                    gamma = alpha + n
                total[:-1] += m
                total[-1] += n.sum(0)
                cells += len(f)
            g, k = np.nonzero(total)
            yield pd.DataFrame({"g": [*g, -1], "k": [*k, 0], "n": [*total[g, k], float(cells)]})

        got = batch.mapInPandas(run, "g int, k int, n double").groupBy("g", "k").agg(F.sum("n").alias("n")).toPandas()  # features x topics
        sums, seen = np.zeros((len(a) + 1, a.shape[1])), got["g"] < 0
        own, cells = got[~seen], float(got.loc[seen, "n"].sum())
        sums[own["g"].to_numpy(int), own["k"].to_numpy(int)] = own["n"]
        if cells:
            sums *= self.n_cells / cells
            self.step += 1
            self.a, self.b = K.svem_mstep(a, b, sums[:-1], sums[-1], min(1.0, K.svem_rate(self.step, self.kappa, self.tau0)))
        state = [(self.step, bytearray(self.a.tobytes()), bytearray(self.b.tobytes()))]
        self.spark.createDataFrame(state, "step long, a binary, b binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number}")
        self.last = number
