"""Cutting the lineage of iterative plans, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of a local session, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        at = f"file://{tempfile.mkdtemp(prefix='topicloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, for iterations with joins.

    A checkpoint keeps its plan's estimate of size, joins multiply those, and from round to round the number itself grows until it
    fills the driver; a written table is as large as its files.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket.
BUCKET_ROWS = 1 << 18


def in_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written in the shared folder in buckets of key, so that joins by key move none of its rows; more buckets for more rows."""
    spark = df.sparkSession
    rows = checkpointed(df)
    n, at = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS)), f"{name}_{uuid.uuid4().hex}"
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{at}").saveAsTable(at)
    return spark.table(at)


class Written:
    """A table that each round of an iteration writes anew in the shared folder; the one before goes when it is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", None
        self.round = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.round += 1
        path, old = f"{self.name}/{self.round}", self.path
        df.write.parquet(path)
        self.path = path
        if old:
            deleted(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)


def stored(path: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Within a task: i, rising, and y (one row each) of a table (i, y) that Written put at path."""
    files, at = fs.FileSystem.from_uri(path)
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    tables = [pq.read_table(name, filesystem=files, columns=["i", "y"], partitioning=None) for name in names]
    i = np.concatenate([np.zeros(0, np.int64), *(t["i"].to_numpy() for t in tables)])
    y = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for t in tables for c in t["y"].chunks)]).reshape(len(i), width)
    order = np.argsort(i)
    return i[order], y[order]


def deleted(spark: SparkSession, path: str) -> None:
    """A folder of the shared one goes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Arrays:
    """Within a task: arrays by name in a folder of the shared one. An array is written under another name and renamed, so that a
    task that runs again leaves a whole one."""

    def __init__(self, folder: str):
        self.files, self.at = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.at, recursive=True)

    def put(self, name: str, x: np.ndarray) -> None:
        held, other = io.BytesIO(), f"{self.at}/{name}.{uuid.uuid4().hex}"
        np.save(held, x, allow_pickle=False)
        with self.files.open_output_stream(other) as out:
            out.write(held.getbuffer())
        self.files.move(other, f"{self.at}/{name}")

    def get(self, name: str) -> np.ndarray:
        with self.files.open_input_stream(f"{self.at}/{name}") as f:
            return np.load(io.BytesIO(f.read()), allow_pickle=False)

    def drop(self, name: str) -> None:
        if self.files.get_file_info(f"{self.at}/{name}").type != fs.FileType.NotFound:
            self.files.delete_file(f"{self.at}/{name}")
