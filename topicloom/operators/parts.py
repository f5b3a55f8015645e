"""Cells' counts cut into parts of cells that follow one another, whose arrays lie in the shared folder and are written once.

A sweep is a job with a task for each part: it reads the part's arrays, and what a fit changes of its cells (their state) lies beside
them and is all that a sweep writes. Sums come back as for any table of cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import Arrays, shared_dir

#: Entries of a part.
PART_ENTRIES = 1 << 22


@dataclass(frozen=True)
class Parts:
    """names: parts that hold cells. lists and single: names of the cells' columns of arrays and of single numbers, cell_id among these."""

    spark: SparkSession
    folder: str
    names: tuple[int, ...]
    lists: tuple[str, ...]
    single: tuple[str, ...]
    cells: int
    round: int = 0

    @classmethod
    def of(cls, cells: DataFrame, ids: DataFrame, start: Callable[[np.ndarray], np.ndarray] | str, lists: tuple[str, ...] = ("idx", "val"), single: tuple[str, ...] = ("cell_id",), entries: int = 0) -> Parts:
        """ids (cell_id) are the cells', from which bounds of the parts are taken without making the cells twice. start(ids) gives the first state, a row for each cell; or it names the column of arrays that holds it.

        entries: how many there are of all cells, about; more of them make more parts.
        """
        spark, folder = cells.sparkSession, f"{shared_dir(cells.sparkSession)}/parts-{uuid.uuid4().hex}"
        state = [start] if isinstance(start, str) else []

        def run(batches):
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            p, x, t = TaskContext.get().partitionId(), Arrays(folder), pa.Table.from_batches(got)
            flat = lambda c: np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in t[c].chunks])
            for c in single:
                x.put(f"{c}_{p}", t[c].to_numpy())
            for c in lists:
                x.put(f"{c}_{p}", flat(c))
                x.put(f"{c}-sizes_{p}", pc.list_value_length(t[c]).to_numpy().astype(np.int32))
            x.put(f"state0_{p}", flat(start).reshape(t.num_rows, -1) if state else start(t["cell_id"].to_numpy()))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64()), "n": pa.array([t.num_rows], pa.int64())})

        slots = spark.sparkContext.defaultParallelism
        n = slots * max(1, -(-entries // (PART_ENTRIES * slots)))
        bounds = sorted(set(ids.select(F.col("cell_id").cast("double").alias("c")).approxQuantile("c", [i / n for i in range(1, n)], 1e-3))) if n > 1 else []
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda v: v < F.col("cell_id").cast("double"))) if bounds else F.lit(0)
        rows = cells.select(*single, *lists, *state).repartitionById(n, part.cast("int")).sortWithinPartitions("cell_id").mapInArrow(run, "part long, n long").collect()  # a row for each part
        return cls(spark, folder, tuple(sorted(r.part for r in rows)), lists, single, sum(r.n for r in rows))

    def map(self, task: Callable, schema: str, keeps: bool = False) -> DataFrame:
        """What task(arrays, state) yields for each part: its arrays by name (lists with their ends, from 0), and its cells' state.

        task yields Arrow batches; with keeps it returns the cells' new state in the end, which `kept` reads.
        """
        names, folder, lists, single, now = self.names, self.folder, self.lists, self.single, self.round

        def run(batches):
            for b in batches:
                for i in b.column("id").to_pylist():
                    p, x = names[i], Arrays(folder)
                    held = {c: x.get(f"{c}_{p}") for c in (*single, *lists)} | {f"{c}-ends": np.concatenate([[0], np.cumsum(x.get(f"{c}-sizes_{p}"), dtype=np.int64)]) for c in lists}
                    new = yield from task(held, x.get(f"state{now}_{p}"))
                    if keeps:
                        x.put(f"state{now + 1}_{p}", new)
                        x.drop(f"state{now - 1}_{p}")  # all of the sweep before have written what this one reads

        return self.spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, schema)

    def kept(self) -> Parts:
        """The cells with the state that a sweep that keeps has written; that sweep must have run."""
        return replace(self, round=self.round + 1)

    def frame(self, state: str) -> DataFrame:
        """The cells as a table again: the columns that they came with, and their state as arrays of that name."""
        lists, single = self.lists, self.single
        kinds = {"cell_id": "long", "level": "int"} | {c: f"array<{'int' if c.endswith('idx') else 'double'}>" for c in lists}

        def task(held, rows):
            n, width = rows.shape
            for a in range(0, n, 1 << 14):
                b = min(n, a + (1 << 14))
                cut = lambda c, a=a, b=b: pa.ListArray.from_arrays((held[f"{c}-ends"][a : b + 1] - held[f"{c}-ends"][a]).astype(np.int32), held[c][held[f"{c}-ends"][a] : held[f"{c}-ends"][b]])
                own = pa.ListArray.from_arrays(np.arange(0, (b - a) * width + 1, width, dtype=np.int32), np.ascontiguousarray(rows[a:b], np.float64).ravel())
                yield pa.RecordBatch.from_pydict({c: pa.array(held[c][a:b]) for c in single} | {c: cut(c) for c in lists} | {state: own})

        return self.map(task, ", ".join(f"{c} {kinds[c]}" for c in (*single, *lists)) + f", {state} array<double>")


def entries_of(counts: DataFrame) -> int:
    return counts.where(F.col("value") != 0).count()
