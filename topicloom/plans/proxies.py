"""Matrices over the test tables: customers are cells, brands, flags and suppliers features, part types topics."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import shared_dir
from ..sources.bundle import TopicData


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a bucket of cells.
BUCKET_LINES = 1 << 18

_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def shared():
    """Within it, a table that several matrices of one query are made from is made and written once."""
    token = _shared.set({})
    try:
        yield
    finally:
        _shared.reset(token)


def _once(make):
    """make(spark, sf_dir) -> DataFrame, or what it gave before in the present query."""

    @wraps(make)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _shared.get()
        if made is None:
            return make(spark, sf_dir)
        if (make.__name__, sf_dir) not in made:
            made[make.__name__, sf_dir] = make(spark, sf_dir)
        return made[make.__name__, sf_dir]

    return get


def by_cell(spark: SparkSession, sf_dir: str, rows: DataFrame, name: str) -> DataFrame:
    """rows written in buckets of cells, so that grouping and joining by cell_id moves none of them again.

    There are more buckets with more lines. Outside a query they are left as they are.
    """
    if _shared.get() is None:
        return rows
    n = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // BUCKET_LINES))
    at = f"{name}_{uuid.uuid4().hex}"
    rows.repartition(n, "cell_id").write.bucketBy(n, "cell_id").sortBy("cell_id").option("path", f"{shared_dir(spark)}/{at}").saveAsTable(at)
    return spark.table(at)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all orders, each with its customer as cell_id and its part's brand and type."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flag"), F.col("l_quantity").cast("double").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))


@_once
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, p_brand, p_type, l_suppkey, flag, q): a row for each line."""
    return by_cell(spark, sf_dir, lines(spark, sf_dir).select("cell_id", "p_brand", "p_type", "l_suppkey", "flag", "q"), "lines")


@_once
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, modality, feature, value): rna counts, protein counts, binary chromatin."""
    # One pass over the lines: each adds to a feature of every modality.
    parts = [F.struct(F.lit(m).alias("modality"), F.col(c).cast("string").alias("feature"), v.alias("v")) for m, c, v in (("rna", "p_brand", F.col("q")), ("protein", "flag", F.lit(1.0)), ("chromatin", "l_suppkey", F.lit(0.0)))]
    rows = base(spark, sf_dir).select("cell_id", F.explode(F.array(*parts)).alias("e")).select("cell_id", "e.*").groupBy("cell_id", "modality", "feature").agg(F.sum("v").alias("value"))
    return by_cell(spark, sf_dir, rows.withColumn("value", F.when(F.col("modality") == "chromatin", 1.0).otherwise(F.col("value"))), "counts")


def topics(b: DataFrame) -> DataFrame:
    """p_type -> k; as many rows as there are part types."""
    return b.select("p_type").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("p_type")) - 1)


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, k, theta): a cell's quantity share in each topic; absent pairs are 0."""
    b = base(spark, sf_dir)
    mass = b.groupBy("cell_id", "p_type").agg(F.sum("q").alias("q"))
    share = F.col("q") / F.sum("q").over(Window.partitionBy("cell_id"))
    return mass.join(F.broadcast(topics(b)), "p_type").select("cell_id", "k", share.alias("theta"))


def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(modality, k, feature, phi)."""
    b = base(spark, sf_dir)
    rna = b.groupBy("p_type", F.col("p_brand").alias("feature")).agg(F.sum("q").alias("w")).withColumn("modality", F.lit("rna"))
    protein = b.groupBy("p_type", F.col("flag").alias("feature")).agg(F.count("*").cast("double").alias("w")).withColumn("modality", F.lit("protein"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("modality", "k"))
    return rna.unionByName(protein).join(F.broadcast(topics(b)), "p_type").select("modality", "k", "feature", share.alias("phi"))


@_once
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cell_idx, batch, label)."""
    from ..operators.prep import dense_index

    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("o_custkey").alias("cell_id")).distinct()
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("batch"), F.col("c_nationkey").alias("label")).join(own, "cell_id", "left_semi")
    return by_cell(spark, sf_dir, dense_index(rows, "cell_id", "cell_idx"), "cells")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring over cells, both ways."""
    c = cells(spark, sf_dir).select("cell_id", "cell_idx")
    n = c.count()
    there = c.select(F.col("cell_id").alias("src"), ((F.col("cell_idx") + 1) % n).alias("cell_idx")).join(c, "cell_idx").select("src", F.col("cell_id").alias("dst"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("weight", F.lit(1.0))


def bundle(spark: SparkSession, sf_dir: str) -> TopicData:
    return TopicData.from_counts(counts(spark, sf_dir), cells=cells(spark, sf_dir), edges={"ring": edges(spark, sf_dir)})


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("point"), F.col("label"))
