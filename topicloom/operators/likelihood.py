"""Log likelihoods per modality of counts under theta and phi, and perplexity.

Non-zeros meet a cell's topics and a feature's topics as one map each; what zeros add follows from sums over cells and
features where it can. Likelihoods whose zeros have no closed form are summed by a numpy kernel, to which phi goes in
blocks of bounded size; no table of cells by features is made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import lgamma, np_lgamma

#: Values of phi that go out with one pass over the cells.
PHI_VALUES = 1 << 21


def topic_map(value: str) -> Column:
    """A group's topics, k -> value; topics are few."""
    return F.map_from_entries(F.collect_list(F.struct("k", value)))


def at_feature(theta: str, phi: str) -> Column:
    """sum over topics of theta[k] phi[k]; absent topics are 0."""
    return F.aggregate(F.map_entries(phi), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.col(theta)[e["key"]], F.lit(0.0)))


def rates(counts: DataFrame, theta: DataFrame, phi: DataFrame) -> DataFrame:
    """counts with column rate = (theta phi) at the stored values."""
    cells, features = theta.groupBy("cell_id").agg(topic_map("theta").alias("__t")), phi.groupBy("modality", "feature").agg(topic_map("phi").alias("__p"))
    met = counts.join(cells, "cell_id").join(features, ["modality", "feature"], "left")
    return met.withColumn("rate", F.coalesce(at_feature("__t", "__p"), F.lit(0.0))).drop("__t", "__p")


def dense_sum(counts: DataFrame, theta: DataFrame, phi: DataFrame, at_zero: Callable, at_value: Callable) -> DataFrame:
    """(modality, ll): sums over all cells of theta and features of phi. at_zero(rate, lib, modality) is what a value 0 adds,
    at_value(x, rate, lib, modality) any other; lib is the cell's sum of the modality's counts, rate = theta phi."""
    spark = phi.sparkSession
    model = phi.select("modality", "feature", "k", "phi").toPandas()  # as large as a model's parameters, which the driver holds
    topics = int(model["k"].max()) + 1 if len(model) else 1
    names = model[["modality", "feature"]].drop_duplicates().sort_values(["modality", "feature"]).reset_index(drop=True)
    place = names.reset_index().merge(model, on=["modality", "feature"])
    matrix = np.zeros((len(names), topics))
    matrix[place["index"].to_numpy(int), place["k"].to_numpy(int)] = place["phi"]
    cells = theta.groupBy("cell_id").agg(F.collect_list("k").alias("ks"), F.collect_list("theta").alias("ts"))
    libs = counts.groupBy("cell_id", "modality").agg(F.sum("value").alias("lib")).groupBy("cell_id").agg(F.collect_list("modality").alias("ms"), F.collect_list("lib").alias("libs"))
    cells, out = cells.join(libs, "cell_id", "left"), spark.createDataFrame([], "modality string, ll double")
    width = max(1, PHI_VALUES // topics)
    for start in range(0, len(names), width):
        some = names.iloc[start : start + width].reset_index(drop=True)
        index = spark.createDataFrame(some.reset_index().rename(columns={"index": "i"}), "i int, modality string, feature string")
        own = counts.join(F.broadcast(index), ["modality", "feature"]).where("value <> 0").groupBy("cell_id").agg(F.collect_list("i").alias("idx"), F.collect_list(F.col("value").cast("double")).alias("val"))
        shared = spark.sparkContext.broadcast(matrix[start : start + width])
        spans = {m: (int(g.index.min()), int(g.index.max()) + 1) for m, g in some.groupby("modality")}

        def run(batches, shared=shared, spans=spans):
            total = dict.fromkeys(spans, 0.0)
            for batch in batches:
                for a in range(0, len(batch), 256):
                    b = batch.iloc[a : a + 256]
                    t = np.zeros((len(b), topics))
                    idx, val, row = [], [], []
                    for r, (ks, ts, i, v) in enumerate(zip(b["ks"], b["ts"], b["idx"], b["val"], strict=True)):
                        np.add.at(t[r], np.asarray(ks, dtype=int)[(known := np.asarray(ks, dtype=int) < topics)], np.asarray(ts)[known])
                        if i is not None:
                            idx.append(np.asarray(i, dtype=int))
                            val.append(np.asarray(v))
                            row.append(np.full(len(i), r))
                    idx, val, row = (np.concatenate(x) if x else np.zeros(0, int) for x in (idx, val, row))
                    for m, (lo, hi) in spans.items():
                        lib = np.array([dict(zip(n, v, strict=True)).get(m, 0.0) if n is not None else 0.0 for n, v in zip(b["ms"], b["libs"], strict=True)])
                        rate, mine = t @ shared.value[lo:hi].T, (idx >= lo) & (idx < hi)
                        r, x = row[mine], val[mine]
                        met = rate[r, idx[mine] - lo]
                        total[m] += at_zero(rate, lib[:, None], m).sum() + (at_value(x, met, lib[r], m) - at_zero(met, lib[r], m)).sum()
            yield pd.DataFrame({"modality": list(total), "ll": list(total.values())})

        out = out.unionByName(cells.join(own, "cell_id", "left").mapInPandas(run, "modality string, ll double"))
    return out.groupBy("modality").agg(F.sum("ll").alias("ll"))


def multinomial(counts: DataFrame, theta: DataFrame, phi: DataFrame, eps: float = 1e-8) -> DataFrame:
    return rates(counts, theta, phi).groupBy("modality").agg(F.sum(F.col("value") * F.log(F.col("rate") + eps)).alias("ll"))


def poisson(counts: DataFrame, theta: DataFrame, phi: DataFrame, eps: float = 1e-8, constant: bool = False) -> DataFrame:
    """sum x log(rate + eps) - rate - eps over all cells and features: the second sum is a product of sums for each topic."""
    term = F.col("value") * F.log(F.col("rate") + eps) - (lgamma(F.col("value") + 1) if constant else F.lit(0.0))
    seen = rates(counts, theta, phi).groupBy("modality").agg(F.sum(term).alias("seen"))
    n = theta.select("cell_id").distinct().count()
    mass = phi.groupBy("modality", "k").agg(F.sum("phi").alias("p")).join(theta.groupBy("k").agg(F.sum("theta").alias("t")), "k").groupBy("modality").agg(F.sum(F.col("p") * F.col("t")).alias("mass"))
    width = phi.groupBy("modality").agg(F.count_distinct("feature").alias("f"))
    return seen.join(mass, "modality").join(width, "modality").select("modality", (F.col("seen") - F.col("mass") - F.col("f") * n * eps).alias("ll"))


def negative_binomial(counts: DataFrame, theta: DataFrame, phi: DataFrame, dispersion: float = 1.0) -> DataFrame:
    """mu = max(rate * lib, 1e-8), size `dispersion`."""
    r = float(dispersion)

    def at_zero(rate, lib, _):
        return r * np.log(r / (r + np.maximum(rate * lib, 1e-8)))

    def at_value(x, rate, lib, m):
        mu = np.maximum(rate * lib, 1e-8)
        return np_lgamma(x + r) - np_lgamma(np.array(r)) - np_lgamma(x + 1) + at_zero(rate, lib, m) + x * np.log(mu / (r + mu))

    return dense_sum(counts, theta, phi, at_zero, at_value)


def gamma_poisson(counts: DataFrame, theta: DataFrame, phi: DataFrame, disp: float) -> DataFrame:
    """The same with size 1 / (disp^2 + 1e-8)."""
    return negative_binomial(counts, theta, phi, 1.0 / (disp * disp + 1e-8))


def _coin(p: Callable):
    """0 and 1 with probability p(rate, lib, modality); larger values count as 1."""

    def at_value(x, rate, lib, m):
        x, q = np.minimum(x, 1.0), p(rate, lib, m)
        return x * np.log(q) + (1 - x) * np.log(1 - q)

    return lambda rate, lib, m: np.log(1 - p(rate, lib, m)), at_value


def bernoulli(counts: DataFrame, theta: DataFrame, phi: DataFrame, eps: float = 1e-7) -> DataFrame:
    """p = min(1, rate * lib / mean lib over all cells), kept off 0 and 1 by eps."""
    n = theta.select("cell_id").distinct().count()
    mean = {r.modality: r.s / n for r in counts.groupBy("modality").agg(F.sum("value").alias("s")).collect()}  # a few modalities
    return dense_sum(counts, theta, phi, *_coin(lambda rate, lib, m: np.clip(rate * lib / mean.get(m, 1.0), eps, 1 - eps)))


def bernoulli_plain(counts: DataFrame, theta: DataFrame, phi: DataFrame, eps: float = 1e-12) -> DataFrame:
    return dense_sum(counts, theta, phi, *_coin(lambda rate, lib, m: np.clip(rate, eps, 1 - eps)))


def gaussian(values: DataFrame, means: DataFrame, sd: DataFrame) -> DataFrame:
    """values (cell_id, feature, value), means (cell_id, feature, mean), sd (feature, sd): dense by nature."""
    rows = values.join(means, ["cell_id", "feature"]).join(F.broadcast(sd), "feature")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return rows.agg(F.sum(-0.5 * z * z - F.log("sd") - 0.9189385332046727).alias("ll"))


def svem_monitor(counts: DataFrame, theta: DataFrame, phi: DataFrame, weight: float = 1.0) -> DataFrame:
    return rates(counts, theta, phi).groupBy("modality").agg((weight * F.sum(F.col("value") * F.log(F.greatest("rate", F.lit(1e-8))))).alias("ll"))


def perplexity(ll: DataFrame, counts: DataFrame) -> DataFrame:
    """(modality, perplexity) = exp(-ll / total); infinite where the total is 0."""
    total = counts.groupBy("modality").agg(F.sum("value").alias("total"))
    return ll.join(total, "modality").select("modality", F.when(F.col("total") > 0, F.exp(-F.col("ll") / F.when(F.col("total") > 0, F.col("total")))).otherwise(F.lit(float("inf"))).alias("perplexity"))


def overall_perplexity(ll: DataFrame, counts: DataFrame) -> DataFrame:
    total = counts.groupBy("modality").agg(F.sum("value").alias("total"))
    s = ll.join(total, "modality").agg(F.sum("ll").alias("ll"), F.sum("total").alias("total"))
    return s.select(F.when(F.col("total") > 0, F.exp(-F.col("ll") / F.when(F.col("total") > 0, F.col("total")))).otherwise(F.lit(float("inf"))).alias("perplexity"))


def shifted_phi(phi: DataFrame, shift: Column, *by: str) -> DataFrame:
    """phi with log phi + shift, and softmax over the features of each modality and topic (and group of `by`)."""
    own = Window.partitionBy(*by, "modality", "k")
    rows = phi.withColumn("__z", F.log(F.greatest("phi", F.lit(1e-12))) + shift)
    rows = rows.withColumn("__e", F.exp(F.col("__z") - F.max("__z").over(own)))
    return rows.select(*by, "modality", "k", "feature", (F.col("__e") / F.sum("__e").over(own)).alias("phi"))


def batch_corrected_phi(phi: DataFrame, tau: DataFrame, delta: DataFrame) -> DataFrame:
    """(batch, modality, k, feature, phi): softmax over features of log phi + tau_k delta_bf. tau (k, tau); delta (batch, feature, delta)."""
    return shifted_phi(phi.join(tau, "k").join(delta, "feature"), F.col("tau") * F.col("delta"), "batch")


def batch_corrected_means(means: DataFrame, tau: DataFrame, delta: DataFrame) -> DataFrame:
    """(batch, modality, k, feature, mean): the Gaussian form, mean + tau_k delta_bf without softmax."""
    return means.join(tau, "k").join(delta, "feature").select("batch", "modality", "k", "feature", (F.col("mean") + F.col("tau") * F.col("delta")).alias("mean"))


def batch_corrected_multinomial(counts: DataFrame, theta: DataFrame, corrected: DataFrame, batches: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(modality, ll) with each cell's rates under its batch's phi. corrected: of batch_corrected_phi; batches (cell_id, batch)."""
    cells = theta.groupBy("cell_id").agg(topic_map("theta").alias("__t")).join(batches.select("cell_id", "batch"), "cell_id")
    features = corrected.groupBy("batch", "modality", "feature").agg(topic_map("phi").alias("__p"))
    met = counts.join(cells, "cell_id").join(features, ["batch", "modality", "feature"], "left")
    return met.groupBy("modality").agg(F.sum(F.col("value") * F.log(F.coalesce(at_feature("__t", "__p"), F.lit(0.0)) + eps)).alias("ll"))


def with_background(phi: DataFrame, background: DataFrame) -> DataFrame:
    """(modality, k, feature, phi): softmax of log phi + the feature's background. background (modality, feature, background)."""
    rows = phi.join(background, ["modality", "feature"], "left").withColumn("__b", F.coalesce("background", F.lit(0.0)))
    return shifted_phi(rows, F.col("__b"))
