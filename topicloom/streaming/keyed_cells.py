"""Topics of cells whose counts arrive in pieces, by keyed state: a cell's counts so far are the state of its key.

A stateful processor (transformWithState) adds each delivery to its cell's counts once and hands on the counts of the cells
that changed; a vectorised step after it gives their topics under fixed rates. A result depends on a cell's counts alone:
not on the order of deliveries, on how they fall into batches, on restarts or on deliveries that come twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.special import np_digamma
from ..operators import kernels as K
from ..operators.inference import sparse

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INPUT = "cell_id long, delivery long, idx array<int>, val array<double>"
COUNTS = "cell_id long, deliveries long, idx array<int>, val array<double>"


class CellCounts(StatefulProcessor):
    """State of a cell, one value: value by feature, and the deliveries it has had; read once and written once for a batch's rows."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("counts", "idx array<int>, val array<double>, seen array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        old = self.state.get() if self.state.exists() else ((), (), ())
        values, seen, changed = dict(zip(old[0], old[1], strict=True)), set(old[2]), False
        for row in rows:
            if row["delivery"] in seen:
                continue
            changed = True
            seen.add(row["delivery"])
            for i, v in zip(row["idx"] or (), row["val"] or ()):
                values[i] = values.get(i, 0.0) + v
        if changed:
            idx = sorted(values)
            val = [values[i] for i in idx]
            self.state.update((idx, val, sorted(seen)))
            yield Row(cell_id=key[0], deliveries=len(seen), idx=idx, val=val)

    def close(self) -> None:
        pass


def counts_so_far(deliveries: DataFrame) -> DataFrame:
    """(cell_id, deliveries, idx, val) of each cell that a batch of (cell_id, delivery, idx, val) changes.

    deliveries may be a stream or a table. A cell's delivery of a number it has had changes nothing; a delivery of null or
    empty arrays counts as one without entries. Rows without cell_id or delivery are left out. State grows with a cell's
    features and deliveries. The session's state store becomes RocksDB where it isn't a store that keyed state can use.
    """
    conf = deliveries.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = deliveries.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("delivery").cast("long").alias("delivery"), "idx", "val").where("cell_id IS NOT NULL AND delivery IS NOT NULL")
    return rows.groupBy("cell_id").transformWithState(statefulProcessor=CellCounts(), outputStructType=COUNTS, outputMode="Append", timeMode="None")


def cell_topics(counts: DataFrame, a: np.ndarray, b: np.ndarray, alpha: float = 0.1, inner_iters: int = 3) -> DataFrame:
    """(cell_id, deliveries, gamma): each row's Dirichlet over topics, where features' rates have shape a and rate b.

    a and b: features by topics, sent once to each executor.
    """
    terms = counts.sparkSession.sparkContext.broadcast((np_digamma(a) - np.log(b), a / b))

    def run(batches):
        e_log, e_rate = terms.value
        for f in batches:
            if not len(f):
                continue
            x, gamma = sparse(f), np.full((len(f), e_rate.shape[1]), alpha + 1.0)
            for _ in range(inner_iters):
                n, _ = K.svem_estep_poisson(x, np_digamma(gamma) - np_digamma(gamma.sum(1, keepdims=True)), e_log, e_rate)
                gamma = alpha + n
            yield pd.DataFrame({"cell_id": f["cell_id"], "deliveries": f["deliveries"], "gamma": list(gamma)})

    return counts.mapInPandas(run, "cell_id long, deliveries long, gamma array<double>")


def latest(updates: DataFrame) -> DataFrame:
    """The last row of each cell in a sink of updates."""
    return updates.groupBy("cell_id").agg(F.max("deliveries").alias("deliveries"), F.max_by("gamma", "deliveries").alias("gamma"))


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, a: np.ndarray, b: np.ndarray, files_per_batch: int = 8, **options) -> DataFrame:
    """Works off the Parquet files of deliveries that source holds and hasn't been seen, and gives each cell's last row.

    Called again with the same checkpoint, after new files or a lost driver, it goes on where it ended.
    """
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = cell_topics(counts_so_far(stream), a, b, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.schema("cell_id long, deliveries long, gamma array<double>").parquet(sink))
