"""Highly variable features by variances that are standardised by a local regression on the means.

Log10 of each feature's variance is regressed on log10 of its mean by local quadratics with tricube weights.
As local regression programs do, the regression is worked out at a bounded number of vertices only, and cubics through the
vertices' values and slopes give every feature's fit. So each step is linear in features: a vertex's bandwidth comes from a
self-join of ranks, its regression from eight weighted sums, a feature's fit from the two vertices around it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import Written
from .prep import dense_index, feature_moments

CONSTANT = 1e-12  # variances below this share of the squared mean are rounding
SINGULAR = 1e-9  # determinants below this share of the weight's power mean a lower degree


def _ranked(moments: DataFrame) -> DataFrame:
    """moments with r, the rank by x from 0 within the modality, and n, the modality's features."""
    rows = dense_index(moments.withColumn("order", F.struct("modality", "x", "feature")), "order", "at").drop("order")
    own = rows.groupBy("modality").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each modality
    return rows.join(F.broadcast(own), "modality").withColumn("r", F.col("at") - F.col("first")).drop("at", "first")


def local_fits(ranked: DataFrame, span: float, knots: int) -> DataFrame:
    """(modality, v, fit, slope): the local regression of y on x at knots + 1 ranks, evenly spread, or fewer where x repeats.

    A vertex weighs the q = span x features that are nearest (4 at least); with too few different x among them it takes a
    line, then a mean.
    """
    hit = F.exists(F.sequence(F.lit(0), F.lit(knots)), lambda j: F.floor(j * (F.col("n") - 1) / F.lit(knots)) == F.col("r"))
    vertices = ranked.where(hit).select("modality", F.col("x").alias("v")).distinct()  # knots + 1 rows for each modality
    q = F.least(F.col("n"), F.greatest(F.floor(F.col("n") * span), F.lit(4)))
    ends = ranked.select("modality", (F.col("r") + q - 1).alias("r"), F.col("x").alias("low")).join(ranked.select("modality", "r", F.col("x").alias("high")), ["modality", "r"])
    # The q nearest of a vertex are q ranks in a row: the stretch whose farther end is nearest.
    wide = ends.join(F.broadcast(vertices), "modality").groupBy("modality", "v").agg(F.min(F.greatest(F.col("v") - F.col("low"), F.col("high") - F.col("v"))).alias("h"))
    d = F.col("x") - F.col("v")
    near = ranked.join(F.broadcast(wide), "modality").where((F.abs(d) < F.col("h")) | (d == 0)).withColumn("u", F.when(F.col("h") > 0, d / F.col("h")).otherwise(0.0))
    near = near.withColumn("w", F.pow(1 - F.pow(F.abs("u"), 3), 3))
    power = lambda i: F.pow("u", F.lit(i))
    s = near.groupBy("modality", "v", "h").agg(*[F.sum(F.col("w") * power(i)).alias(f"s{i}") for i in range(5)], *[F.sum(F.col("w") * power(i) * F.col("y")).alias(f"t{i}") for i in range(3)])
    det = F.expr("s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)")
    s = s.withColumn("det3", det).withColumn("det2", F.expr("s0 * s2 - s1 * s1"))
    three, two = F.col("det3") > SINGULAR * F.pow("s0", F.lit(3)), F.col("det2") > SINGULAR * F.pow("s0", F.lit(2))
    fit = F.when(three, F.expr("(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det3")).when(two, F.expr("(t0 * s2 - s1 * t1) / det2")).otherwise(F.expr("t0 / s0"))
    slope = F.when(three, F.expr("(s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det3 / h")).when(two, F.expr("(s0 * t1 - s1 * t0) / det2 / h")).otherwise(0.0)
    return s.select("modality", "v", fit.alias("fit"), slope.alias("slope"))


def trend(moments: DataFrame, span: float = 0.3, knots: int | None = None) -> DataFrame:
    """moments (modality, feature, mean, var, both above 0) with x, y and trend, the local regression's value of y at x.

    knots is 5 / span where it isn't given. Features of the same mean have the same trend.
    """
    if not 0 < span <= 1:
        raise ValueError("span must be above 0 and at most 1")
    knots = knots or math.ceil(5 / span)
    rows = _ranked(moments.withColumns({"x": F.log10("mean"), "y": F.log10("var")}))
    rows = Written(moments.sparkSession, "ranked").put(rows)
    own = Window.partitionBy("modality").orderBy("v")  # knots + 1 rows
    pieces = local_fits(rows, span, knots).select("modality", F.col("v").alias("low"), F.lead("v").over(own).alias("high"), F.col("fit").alias("f0"), F.col("slope").alias("g0"), F.lead("fit").over(own).alias("f1"), F.lead("slope").over(own).alias("g1"))
    inside = (F.col("p.low") <= F.col("m.x")) & (F.col("p.high").isNull() | (F.col("m.x") < F.col("p.high")))
    rows = rows.alias("m").join(F.broadcast(pieces.alias("p")), (F.col("m.modality") == F.col("p.modality")) & inside).select("m.*", "p.low", "p.high", "p.f0", "p.g0", "p.f1", "p.g1")
    rows = rows.withColumn("t", (F.col("x") - F.col("low")) / (F.col("high") - F.col("low")))
    cubic = F.expr("(1 + 2 * t) * (1 - t) * (1 - t) * f0 + t * (1 - t) * (1 - t) * (high - low) * g0 + t * t * (3 - 2 * t) * f1 + t * t * (t - 1) * (high - low) * g1")
    return rows.withColumn("trend", F.coalesce(cubic, "f0")).drop("low", "high", "f0", "g0", "f1", "g1", "t", "r", "n")


def standardised_variances(counts: DataFrame, n_cells: int, span: float = 0.3, knots: int | None = None) -> DataFrame:
    """(modality, feature, mean, var, trend, score): score is the variance (ddof 1) of (x - mean) / sd, sd being the trend's,
    with x at most mean + sd x sqrt(cells). Features without variance (see CONSTANT) or with a mean not above 0 score 0, trend null."""
    if n_cells < 2:
        raise ValueError("variances need two cells")
    moments = feature_moments(counts, n_cells).withColumn("var", F.col("var") * n_cells / (n_cells - 1))
    moments = Written(counts.sparkSession, "moments").put(moments)
    usable = (F.col("mean") > 0) & (F.col("var") > CONSTANT * F.col("mean") * F.col("mean"))
    fits = trend(moments.where(usable), span, knots).withColumn("sd", F.sqrt(F.pow(F.lit(10.0), "trend"))).withColumn("most", F.col("mean") + F.col("sd") * math.sqrt(n_cells))
    x = F.least("value", "most")
    sums = counts.join(fits.select("modality", "feature", "most"), ["modality", "feature"]).groupBy("modality", "feature").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    score = (n_cells * F.col("mean") * F.col("mean") + F.col("q") - 2 * F.col("mean") * F.col("s")) / ((n_cells - 1) * F.col("sd") * F.col("sd"))
    got = fits.join(sums, ["modality", "feature"]).select("modality", "feature", "mean", "var", "trend", score.alias("score"))
    return got.unionByName(moments.where(~usable | F.isnull("var")).select("modality", "feature", "mean", "var", F.lit(None).cast("double").alias("trend"), F.lit(0.0).alias("score")))


def loess_hvg(counts: DataFrame, n_cells: int, n: int, span: float = 0.3, knots: int | None = None) -> DataFrame:
    """The n features of each modality with the largest scores, with their rank from 1; like scores by feature."""
    order = Window.partitionBy("modality").orderBy(F.desc(F.round("score", 6)), "feature")
    return standardised_variances(counts, n_cells, span, knots).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
