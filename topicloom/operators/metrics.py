"""Queries over a factorisation: theta (cell_id, k, theta) and phi (modality, k, feature, phi); absent pairs are 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of a modality's features that go out with one pass over the other's.
FEATURE_VALUES = 1 << 20


def complete_theta(theta: DataFrame) -> DataFrame:
    """theta with a row for every cell and topic; topics are few."""
    pairs = theta.select("cell_id").distinct().join(F.broadcast(theta.select("k").distinct()))
    return pairs.join(theta, ["cell_id", "k"], "left").select("cell_id", "k", F.coalesce("theta", F.lit(0.0)).alias("theta"))


def normalised_theta(theta: DataFrame) -> DataFrame:
    return theta.withColumn("theta", F.col("theta") / (F.sum("theta").over(Window.partitionBy("cell_id")) + 1e-12))


def cell_entropy(theta: DataFrame, normalised: bool = True, eps: float = 1e-8) -> DataFrame:
    t = normalised_theta(theta) if normalised else theta
    return t.groupBy("cell_id").agg((-F.sum(F.col("theta") * F.log(F.greatest("theta", F.lit(eps))))).alias("entropy"))


def mean_entropy(theta: DataFrame, normalised: bool = True) -> DataFrame:
    return cell_entropy(theta, normalised).agg(F.avg("entropy").alias("mean_entropy"))


def topic_cosines(phi: DataFrame) -> DataFrame:
    """(modality, k, l, cosine) for k < l: dot products of topics, added up for each batch of features, then by Spark."""
    features = phi.groupBy("modality", "feature").agg(F.collect_list("k").alias("ks"), F.collect_list("phi").alias("ps"))

    def products(batches):
        total: dict[str, dict[tuple[int, int], float]] = {}
        for batch in batches:
            for modality, ks, ps in zip(batch["modality"], batch["ks"], batch["ps"], strict=True):
                own = total.setdefault(modality, {})
                order = sorted(zip(ks, ps, strict=True))
                for i, (k, p) in enumerate(order):
                    for j, q in order[i:]:
                        own[k, j] = own.get((k, j), 0.0) + p * q
        rows = [(m, k, j, v) for m, own in total.items() for (k, j), v in own.items()]
        yield pd.DataFrame(rows, columns=["modality", "k", "l", "dot"])

    dots = features.mapInPandas(products, "modality string, k int, l int, dot double").groupBy("modality", "k", "l").agg(F.sum("dot").alias("dot"))
    norms = dots.where("k = l").select("modality", "k", (F.sqrt("dot") + 1e-12).alias("norm"))
    ks = phi.select("modality", F.col("k").cast("int").alias("k")).distinct().join(norms, ["modality", "k"])
    pairs = ks.alias("a").join(ks.alias("b"), "modality").where("a.k < b.k").select("modality", F.col("a.k").alias("k"), F.col("b.k").alias("l"), (F.col("a.norm") * F.col("b.norm")).alias("n"))
    return pairs.join(dots, ["modality", "k", "l"], "left").select("modality", "k", "l", (F.coalesce("dot", F.lit(0.0)) / F.col("n")).alias("cosine"))


def topic_diversity(phi: DataFrame) -> DataFrame:
    """1 - mean cosine of each modality's topic pairs; no row with a single topic."""
    return topic_cosines(phi).groupBy("modality").agg((1 - F.avg("cosine")).alias("diversity"))


def mean_topic_diversity(phi: DataFrame) -> DataFrame:
    return topic_diversity(phi).agg(F.avg("diversity").alias("diversity"))


def top_features(phi: DataFrame, n: int = 10) -> DataFrame:
    """The n features of each topic with the largest phi, ties by name; none for n = 0."""
    order = Window.partitionBy("modality", "k").orderBy(F.desc(F.round("phi", 9)), "feature")
    return phi.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("modality", "k", "rank", "feature", "phi")


def top_features_wide(phi: DataFrame, n: int = 5) -> DataFrame:
    ranks = list(range(1, n + 1))
    wide = top_features(phi, n).groupBy("modality", "k").pivot("rank", ranks).agg(F.first("feature"))
    return wide.select("modality", "k", *[F.col(str(r)).alias(f"rank_{r}") for r in ranks])


def mean_topic(theta: DataFrame) -> DataFrame:
    """(k, mean): average share of each topic over all cells."""
    n = theta.select("cell_id").distinct().count()
    return normalised_theta(theta).groupBy("k").agg((F.sum("theta") / n).alias("mean"))


def cross_modality(theta: DataFrame, phi: DataFrame, a: str, b: str, normalise: bool = True) -> DataFrame:
    """(feature_a, feature_b, score): sum over topics of mean share times the features' topic profiles."""
    if a == b:
        raise ValueError("two modalities are needed")
    spark = phi.sparkSession
    profile = phi.withColumn("p", F.col("phi") / (F.sum("phi").over(Window.partitionBy("modality", "feature")) + 1e-12))
    rows = lambda m: profile.where(F.col("modality") == m).groupBy("feature").agg(F.collect_list("k").alias("ks"), F.collect_list("p").alias("ps"))
    share = {r.k: r["mean"] for r in mean_topic(theta).collect()}  # one row for each topic
    topics = max(share, default=-1) + 1
    mean = np.array([share.get(k, 0.0) for k in range(topics)])

    def matrix(batch):
        out = np.zeros((len(batch), topics))
        for r, (ks, ps) in enumerate(zip(batch["ks"], batch["ps"], strict=True)):
            for k, p in zip(ks, ps, strict=True):
                if k < topics:
                    out[r, k] = p
        return out

    right, score = rows(b), spark.createDataFrame([], "feature_a string, feature_b string, score double")
    n = right.count()
    blocks = max(1, -(-n * max(topics, 1) // FEATURE_VALUES))
    for i in range(blocks):  # the other modality's features go out in blocks of bounded size
        block = right.where(F.pmod(F.xxhash64("feature"), F.lit(blocks)) == i).orderBy("feature").toPandas()
        shared = spark.sparkContext.broadcast((block["feature"].tolist(), matrix(block) * mean))

        def products(batches, shared=shared):
            names, other = shared.value
            for batch in batches:
                for start in range(0, len(batch), 64):
                    some = batch.iloc[start : start + 64]
                    met = matrix(some) @ other.T
                    yield pd.DataFrame({"feature_a": np.repeat(some["feature"].to_numpy(), len(names)), "feature_b": names * len(some), "score": met.ravel()})

        score = score.unionByName(rows(a).mapInPandas(products, score.schema))
    if not normalise:
        return score
    top = score.agg(F.max("score").alias("top"))
    return score.join(F.broadcast(top)).select("feature_a", "feature_b", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def topic_variance(theta: DataFrame) -> DataFrame:
    """Variance (ddof 1) of each topic over cells, absent pairs being 0."""
    n = theta.select("cell_id").distinct().count()
    s, q = F.sum("theta"), F.sum(F.col("theta") * F.col("theta"))
    return theta.groupBy("k").agg(((q - s * s / n) / (n - 1)).alias("variance"))


def dominant_topic(theta: DataFrame) -> DataFrame:
    """(cell_id, k): the topic with the largest share, the first of equal ones."""
    return theta.groupBy("cell_id").agg(F.max(F.struct(F.round("theta", 12).alias("t"), (-F.col("k")).alias("n"))).alias("m")).select("cell_id", (-F.col("m.n")).alias("k"))


def dominant_counts(theta: DataFrame) -> DataFrame:
    n = dominant_topic(theta).groupBy("k").agg(F.count("*").alias("cells"))
    return n.withColumn("percent", F.col("cells") * 100.0 / F.sum("cells").over(Window.partitionBy(F.lit(1))))


def hellinger(theta: DataFrame) -> DataFrame:
    return theta.withColumn("root", F.sqrt(F.greatest("theta", F.lit(0.0)))).select("cell_id", "k", "root")


def topic_feature_counts(counts: DataFrame, theta: DataFrame) -> DataFrame:
    """(modality, k, feature, n): theta^T X. A cell's topics meet its counts as one map, and are summed before the shuffle."""
    cells = theta.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "theta"))).alias("t"))
    met = counts.join(cells, "cell_id").select("modality", "feature", "value", F.explode("t").alias("k", "theta"))
    return met.groupBy("modality", "k", "feature").agg(F.sum(F.col("theta") * F.col("value")).alias("n"))


def attention_weights(locations: DataFrame, w: list[list[float]], u: list[float]) -> DataFrame:
    """(cell_id, modality, weight): softmax over a cell's modalities of tanh(mu W) u; locations has cell_id, modality, mu, present.

    Absent modalities get 0, unless a cell has none: then all are equal.
    """
    hidden = [F.tanh(sum((F.element_at("mu", i + 1) * row[j] for i, row in enumerate(w)), F.lit(0.0))) for j in range(len(u))]
    logit = sum((h * x for h, x in zip(hidden, u, strict=True)), F.lit(0.0))
    own = Window.partitionBy("cell_id")
    rows = locations.withColumn("z", F.when(F.col("present") > 0, logit).otherwise(F.lit(-1e5)))
    rows = rows.withColumn("z", F.exp(F.col("z") - F.max("z").over(own)))
    return rows.select("cell_id", "modality", (F.col("z") / F.sum("z").over(own)).alias("weight"))


def learned_dispersion(rows: DataFrame) -> DataFrame:
    """Means of log-normal posteriors with columns mu and sigma."""
    return rows.withColumn("dispersion", F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2))


def theta_by_group(theta: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    sizes = cells.groupBy(label).agg(F.count("*").alias("size"))
    return theta.join(cells.select("cell_id", label), "cell_id").groupBy(label, "k").agg(F.sum("theta").alias("s")).join(sizes, label).select(label, "k", (F.col("s") / F.col("size")).alias("mean"))


def modality_weights(present: DataFrame, mode: str = "equal", weights: dict[str, float] | None = None) -> DataFrame:
    """(cell_id, modality, weight): masked softmax over a cell's modalities; a cell without any has equal weights.

    equal: 1 / M for all. universal: softmax of the given weights for all. cell: softmax over what the cell has.
    """
    names = sorted(weights) if weights else [r[0] for r in present.select("modality").distinct().collect()]
    raw = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(float((weights or {}).get(m, 0.0))))])[F.col("modality")]
    if mode == "equal":
        raw = F.lit(0.0)
    logit = F.when(F.col("present") == 0, -1e5).otherwise(raw) if mode == "cell" else raw
    own = Window.partitionBy("cell_id")
    rows = present.withColumn("z", logit).withColumn("z", F.exp(F.col("z") - F.max("z").over(own)))
    return rows.select("cell_id", "modality", (F.col("z") / F.sum("z").over(own)).alias("weight"))


def likelihood_weights(features: DataFrame, mode: str = "none", ref: str = "mean") -> DataFrame:
    """(modality, weight): 1, F_ref / F_m or its root; F_ref the mean, lower median or maximum of feature numbers."""
    n = features.groupBy("modality").agg(F.count("*").cast("double").alias("f"))
    to = {"mean": F.avg("f"), "max": F.max("f"), "median": F.expr("percentile_disc(0.5) within group (order by f)")}[ref]
    rows = n.join(F.broadcast(n.agg(to.alias("ref"))))
    share = F.col("ref") / F.col("f")
    return rows.select("modality", {"none": F.lit(1.0), "linear": share, "sqrt": F.sqrt(share)}[mode].alias("weight"))


def logistic_normal(alpha: list[float]) -> tuple[list[float], list[float]]:
    """Location and scale of the logistic-normal that stands for a Dirichlet."""
    import numpy as np

    a = np.asarray(alpha, dtype=np.float64)
    k = len(a)
    return list(np.log(a) - np.log(a).mean()), list(np.sqrt((1 - 2 / k) / a + (1 / a).sum() / k**2))


def logistic_normal_rows(rows: DataFrame, key: str, alpha: str) -> DataFrame:
    """(key, i, mu, sigma) for each row's array of concentrations: the logistic-normal that stands for its Dirichlet."""
    n, total = F.size(alpha), lambda f: F.aggregate(F.transform(alpha, f), F.lit(0.0), lambda s, v: s + v)
    mean, inverse = total(lambda a: F.log(a)) / n, total(lambda a: 1 / a)
    each = F.transform(alpha, lambda a: F.struct((F.log(a) - mean).alias("mu"), F.sqrt((1 - 2 / n) / a + inverse / (n * n)).alias("sigma")))
    return rows.select(key, F.posexplode(each).alias("i", "e")).select(key, "i", "e.mu", "e.sigma")


def horseshoe(rows: DataFrame) -> DataFrame:
    """multiplier of columns caux, tau, delta, lam."""
    t = F.pow(F.col("tau") * F.col("delta") * F.col("lam"), F.lit(2))
    c = F.col("caux") * F.col("caux")
    return rows.withColumn("multiplier", F.sqrt(c * t / (c + t + 1e-8)))


def mixture_of_gaussians(rows: DataFrame, key: str) -> DataFrame:
    """(key, mean, var) from columns weight, mu, v: total variance."""
    m = rows.groupBy(key).agg(F.sum(F.col("weight") * F.col("mu")).alias("mean"), F.sum(F.col("weight") * F.col("v")).alias("within"), F.sum(F.col("weight") * F.col("mu") * F.col("mu")).alias("square"))
    return m.select(key, "mean", F.greatest(F.col("within") + F.col("square") - F.col("mean") * F.col("mean"), F.lit(1e-5)).alias("var"))
