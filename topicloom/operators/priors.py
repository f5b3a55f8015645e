"""Priors: the rules for their parameters, and draws from them as column expressions.

A draw follows from the seed, the parameter's name and the row's keys by a hash, so that a lost task draws the same again
and no table is needed beside the rows that get the parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import horseshoe, logistic_normal


def cell_prior(n_topics: int, alpha: float | list[float] | None = None) -> tuple[list[float], list[float]]:
    """Location and scale of the logistic-normal; alpha is 1 / n_topics, one number for all topics, or one for each."""
    given = [1.0 / n_topics] if alpha is None else [float(alpha)] if isinstance(alpha, (int, float)) else list(map(float, alpha))
    if len(given) not in (1, n_topics):
        raise ValueError(f"alpha has {len(given)} values for {n_topics} topics")
    if min(given) <= 0:
        raise ValueError("alpha must be positive")
    return logistic_normal(given * n_topics if len(given) == 1 else given)


def feature_prior(n_topics: int, beta: float | None = None) -> float:
    """1 / n_topics, or the one number given."""
    if beta is None:
        return 1.0 / n_topics
    if not isinstance(beta, (int, float)):
        raise ValueError("the prior of topics over features is one number, not a list")
    return float(beta)


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number between 0 and 1, neither included, for the row's keys."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *map(F.col, keys)), F.lit(1 << 52))
    return (bits + 0.5) / float(1 << 52)


def half_cauchy(u: Column, scale: float = 1.0) -> Column:
    return scale * F.tan(u * (math.pi / 2))


def normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def inverse_gamma_half(u: Column, v: Column) -> Column:
    """InverseGamma(1/2, 1/2): one over a squared normal."""
    return 1 / F.pow(normal(u, v), F.lit(2))


def beta_half(u: Column) -> Column:
    """Beta(1/2, 1/2), the arcsine law."""
    return F.pow(F.sin(u * (math.pi / 2)), F.lit(2))


def student_t10(z: Column, us: list[Column], scale: float) -> Column:
    """Ten degrees of freedom: a normal over the root of a mean of five exponentials."""
    return scale * z / F.sqrt(sum((-F.ln(u) for u in us), F.lit(0.0)) / 5)


def over_topics(features: DataFrame, n_topics: int) -> DataFrame:
    """(modality, feature, k)."""
    return features.select("modality", "feature", F.explode(F.sequence(F.lit(0), F.lit(n_topics - 1))).alias("k"))


def horseshoe_prior(features: DataFrame, n_topics: int, seed: int = 0) -> DataFrame:
    """(modality, feature, k, caux, tau, delta, lam, multiplier, weight): a modality's slab, scales of topic, feature and
    both, and the weight that they shrink."""
    key = ("modality", "k", "feature")
    rows = over_topics(features, n_topics).withColumns({
        "caux": inverse_gamma_half(uniform(seed, "caux", "modality"), uniform(seed, "caux angle", "modality")),
        "tau": half_cauchy(uniform(seed, "tau", "modality", "k")),
        "delta": half_cauchy(uniform(seed, "delta", "modality", "feature")),
        "lam": half_cauchy(uniform(seed, "lam", *key)),
    })
    return horseshoe(rows).withColumn("weight", F.col("multiplier") * normal(uniform(seed, "weight", *key), uniform(seed, "weight angle", *key)))


def dispersion_prior(features: DataFrame, per_feature: bool = False, seed: int = 0) -> DataFrame:
    """(modality, feature, dispersion): half-Cauchy, one for each modality or each feature."""
    key = ("modality", "feature") if per_feature else ("modality",)
    return features.select("modality", "feature").withColumn("dispersion", half_cauchy(uniform(seed, "dispersion", *key)))


def scale_prior(features: DataFrame, seed: int = 0) -> DataFrame:
    """(modality, feature, sd): half-Cauchy scales of Gaussian features."""
    return features.select("modality", "feature").withColumn("sd", half_cauchy(uniform(seed, "sd", "modality", "feature")))


def batch_prior(features: DataFrame, batches: DataFrame, n_topics: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """tau (modality, k, tau) from Beta(1/2, 1/2), and delta (modality, feature, batch, delta) from a narrow Student t.

    batches: one column batch, one row for each; a covariate has few levels, which are paired with every feature.
    """
    levels = batches.select("batch").distinct().agg(F.collect_list("batch").alias("levels"))
    tau = over_topics(features.select("modality", F.lit("").alias("feature")).distinct(), n_topics).select("modality", "k").withColumn("tau", beta_half(uniform(seed, "batch tau", "modality", "k")))
    key = ("modality", "feature", "batch")
    delta = features.select("modality", "feature").join(F.broadcast(levels)).select("modality", "feature", F.explode("levels").alias("batch"))
    z = normal(uniform(seed, "shift", *key), uniform(seed, "shift angle", *key))
    return tau, delta.withColumn("delta", student_t10(z, [uniform(seed, f"shift {i}", *key) for i in range(5)], 0.01))
