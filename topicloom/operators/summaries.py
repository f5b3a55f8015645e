"""Small summaries of results: repeated runs, histograms, the largest and the best rows, run names, tables of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over_runs(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, sd, n): mean and deviation (ddof 0) of a value over a group's runs."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def weight_stats(weights: DataFrame) -> DataFrame:
    """(modality, mean, sd): of modality weights over cells, with ddof 1."""
    return weights.groupBy("modality").agg(F.avg("weight").alias("mean"), F.stddev_samp("weight").alias("sd"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of equal-width bins from the smallest to the largest value, which is in the last; empty bins are left out."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_by_max_abs(rows: DataFrame, key: str, value: str, n: int = 50) -> DataFrame:
    """(key, size): the n keys whose largest absolute value is largest, ties by key."""
    return rows.groupBy(key).agg(F.max(F.abs(value)).alias("size")).orderBy(F.desc(F.round("size", 9)), key).limit(n)


def best_of(rows: DataFrame, by: str, name: str, score: str) -> DataFrame:
    """(by, name, score): the name with the largest score in each group, ties by name."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), name)
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(by, name, score)


def hvg_prefix(ranked: DataFrame, n: int) -> DataFrame:
    """The first n features of each modality by rank; those without rank come last, by falling norm, then by name."""
    order = Window.partitionBy("modality").orderBy(F.col("rank").asc_nulls_last(), F.desc("norm"), "feature")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def parse_run(rows: DataFrame, column: str) -> DataFrame:
    """Columns encoder, layers and weighting of a run's name: gcn or gat with a number of layers, else mlp; equal, universal or cell."""
    name = F.lower(column)
    encoder = F.when(name.contains("gcn"), "gcn").when(name.contains("gat"), "gat").when(name.contains("sgc"), "sgc").otherwise("mlp")
    layers = F.expr(f"try_cast(nullif(regexp_extract(lower({column}), '(?:gcn|gat|sgc)([0-9]+)', 1), '') as long)")
    weighting = F.when(name.contains("universal"), "universal").when(name.contains("cell"), "cell").otherwise("equal")
    return rows.withColumns({"encoder": encoder, "layers": layers, "weighting": weighting})


def merge_metrics(left: DataFrame, right: DataFrame, on: str = "method") -> DataFrame:
    return left.join(right, on)


def summary_table(metrics: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) from frames of one row and one column."""
    out = None
    for name, df in metrics.items():
        row = df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def capped(rows: DataFrame, max_items: int | None, *order: str) -> DataFrame:
    """The first max_items rows in the given order; all for None."""
    return rows if max_items is None else rows.orderBy(*order).limit(max_items)


def burnin_windows(history: DataFrame, run: str, at: str, value: str, window: int = 20, rtol: float = 1e-4, patience: int = 3, least: int = 50) -> DataFrame:
    """(run, at, change, streak, converged) of many runs' histories: what kernels.burnin_trace says of each, by window frames.

    A run's history is bounded by its iterations, which `at` counts from 1.
    """
    own = Window.partitionBy(run).orderBy(at)
    mean = lambda a, b: F.avg(value).over(own.rowsBetween(a, b))
    rows = history.select(run, at, mean(1 - window, 0).alias("new"), mean(1 - 2 * window, -window).alias("old"))
    change = F.when(F.col(at) >= max(least, 2 * window), F.abs(F.col("new") - F.col("old")) / (F.abs(F.col("old")) + 1e-12))
    rows = rows.withColumn("change", change).withColumn("broken", ~F.coalesce(F.col("change") < rtol, F.lit(False)))
    rows = rows.withColumn("streak", F.col(at) - F.coalesce(F.max(F.when(F.col("broken"), F.col(at))).over(own), F.lit(0)))
    return rows.select(run, at, "change", "streak", (F.max("streak").over(own) >= patience).alias("converged"))
