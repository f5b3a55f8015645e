"""Projection, filtering and normalisation of long counts (cell_id, modality, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed


def dense_index(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a contiguous index from 0 in the order of the unique column key, without one task for all rows."""
    # Cut once and written: two uses would sample other bounds, or merge parts otherwise, and rows of unmatched parts would go.
    ranged = checkpointed(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.withColumn("__b", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return ranged.withColumn("__r", own).join(F.broadcast(before), "__p").withColumn(name, (F.col("__r") + F.col("__b")).cast("long")).drop("__p", "__r", "__b")


def select_modalities(counts: DataFrame, names: list[str]) -> DataFrame:
    return counts.where(F.col("modality").isin(names))


def select_layer(counts: DataFrame, layer: str) -> DataFrame:
    return counts.where(F.col("layer") == layer).drop("layer")


def select_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    return counts.join(cells.select("cell_id"), "cell_id", "left_semi")


def binarize(counts: DataFrame, positive_only: bool = True) -> DataFrame:
    """1 for values above 0 (or other than 0); the rest goes."""
    return counts.where("value > 0" if positive_only else "value <> 0").withColumn("value", F.lit(1.0))


def drop_zero_features(counts: DataFrame) -> DataFrame:
    used = counts.groupBy("modality", "feature").agg(F.sum("value").alias("s")).where("s > 0")
    return counts.join(used.select("modality", "feature"), ["modality", "feature"], "left_semi")


def filter_features(counts: DataFrame, min_counts: float = 0, min_cells: int = 0) -> DataFrame:
    used = counts.where("value <> 0").groupBy("modality", "feature").agg(F.sum("value").alias("s"), F.count("*").alias("n")).where((F.col("s") >= min_counts) & (F.col("n") >= min_cells))
    return counts.join(used.select("modality", "feature"), ["modality", "feature"], "left_semi")


def filter_cells(counts: DataFrame, min_features: int) -> DataFrame:
    used = counts.where("value <> 0").groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_features)
    return counts.join(used.select("cell_id"), "cell_id", "left_semi")


def feature_moments(counts: DataFrame, n_cells: int) -> DataFrame:
    """(modality, feature, mean, var) over all cells, absent values being 0; variance with ddof 0."""
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return counts.groupBy("modality", "feature").agg((s / n_cells).alias("mean"), (q / n_cells - (s / n_cells) * (s / n_cells)).alias("var"))


def top_variance_features(counts: DataFrame, n_cells: int, n: int) -> DataFrame:
    order = Window.partitionBy("modality").orderBy(F.desc(F.round("var", 6)), "feature")
    return feature_moments(counts, n_cells).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("modality", "feature", "rank", "var")


def dispersion_hvg(counts: DataFrame, n_cells: int, n: int, bins: int = 20) -> DataFrame:
    """Highly variable features: dispersion var / mean, standardised within bins of like mean; first n by rank."""
    m = feature_moments(counts, n_cells).where("mean > 0").withColumn("dispersion", F.col("var") / F.col("mean"))
    m = m.withColumn("bin", F.ntile(bins).over(Window.partitionBy("modality").orderBy("mean", "feature")))
    own = Window.partitionBy("modality", "bin")
    spread = F.stddev_samp("dispersion").over(own)
    norm = F.when(spread > 0, (F.col("dispersion") - F.avg("dispersion").over(own)) / spread).otherwise(F.lit(0.0))
    m = m.withColumn("norm", norm)
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("modality").orderBy(F.desc("norm"), "feature"))).where(F.col("rank") <= n)


def library_sizes(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, modality, lib) for every cell and modality; 0 where a cell has nothing."""
    names = counts.select("modality").distinct()  # a few rows
    sums = counts.groupBy("cell_id", "modality").agg(F.sum("value").alias("lib"))
    return cells.select("cell_id").join(F.broadcast(names)).join(sums, ["cell_id", "modality"], "left").select("cell_id", "modality", F.greatest(F.coalesce("lib", F.lit(0.0)), F.lit(0.0)).alias("lib"))


def presence(counts: DataFrame, cells: DataFrame, gaussian: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, modality, present): counts add up to more than 0; continuous modalities are there if any value is."""
    there = library_sizes(counts.withColumn("value", F.when(F.col("modality").isin(list(gaussian)), 1.0).otherwise(F.col("value"))), cells)
    return there.select("cell_id", "modality", (F.col("lib") > 0).cast("int").alias("present"))


def normalize_log1p(counts: DataFrame, target: float = 1e4) -> DataFrame:
    lib = counts.groupBy("cell_id", "modality").agg(F.sum("value").alias("lib"))
    return counts.join(lib, ["cell_id", "modality"]).withColumn("value", F.log1p(F.col("value") / F.col("lib") * target)).drop("lib")


def median_depth_log1p(counts: DataFrame, cells: DataFrame, gaussian: tuple[str, ...] = ()) -> DataFrame:
    """log1p(x / max(lib, 1) * the lower median of lib over all cells); continuous modalities pass."""
    lib = library_sizes(counts, cells)
    mid = lib.groupBy("modality").agg(F.expr("percentile_disc(0.5) within group (order by lib)").alias("mid"))
    rows = counts.join(lib, ["cell_id", "modality"]).join(F.broadcast(mid), "modality")
    value = F.when(F.col("modality").isin(list(gaussian)), F.col("value")).otherwise(F.log1p(F.col("value") / F.greatest("lib", F.lit(1.0)) * F.col("mid")))
    return rows.withColumn("value", value).drop("lib", "mid")


def scale_features(counts: DataFrame, n_cells: int) -> DataFrame:
    """z-scores of the stored values with ddof 1, zeros counted in mean and deviation; column zero is what the feature's absent zeros become."""
    m = feature_moments(counts, n_cells).withColumn("sd", F.sqrt(F.col("var") * n_cells / (n_cells - 1)))
    return counts.join(m, ["modality", "feature"]).withColumn("zero", F.when(F.col("sd") > 0, -F.col("mean") / F.col("sd")).otherwise(0.0)).withColumn("value", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("mean", "var", "sd")


def clamp_round(counts: DataFrame, binary: bool = False) -> DataFrame:
    """Observations as the likelihoods take them: not below 0 (nor above 1), rounded half to even."""
    x = F.greatest("value", F.lit(0.0))
    return counts.withColumn("value", F.bround(F.least(x, F.lit(1.0)) if binary else x))


def feature_background(counts: DataFrame, n_cells: int, offset: float = 1e-15) -> DataFrame:
    """(modality, feature, background): log of the mean share over all cells, plus offset."""
    lib = counts.groupBy("cell_id", "modality").agg(F.sum("value").alias("lib"))
    share = F.col("value") / F.when(F.col("lib") == 0, 1.0).otherwise(F.col("lib"))
    return counts.join(lib, ["cell_id", "modality"]).groupBy("modality", "feature").agg(F.log(F.sum(share) / n_cells + offset).alias("background"))


def scalar_prior(counts: DataFrame, n_cells: int) -> DataFrame:
    """(modality, gamma, tau): mean^2 / var and mean / var over the whole matrix."""
    s = counts.groupBy("modality").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), (F.count_distinct("feature") * n_cells).alias("n"))
    s = s.withColumn("mean", F.col("s") / F.col("n")).withColumn("var", F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(1e-6)))
    return s.select("modality", (F.col("mean") * F.col("mean") / F.col("var")).alias("gamma"), (F.col("mean") / F.col("var")).alias("tau"))


def gene_prior(counts: DataFrame, n_cells: int) -> DataFrame:
    m = feature_moments(counts, n_cells).withColumn("var", F.greatest("var", F.lit(1e-6)))
    return m.select("modality", "feature", (F.col("mean") * F.col("mean") / F.col("var")).alias("shape"), (F.col("mean") / F.col("var")).alias("rate"))


def dirichlet_prior(counts: DataFrame, kappa: float = 1.0, floor: float = 1e-3) -> DataFrame:
    """(modality, feature, beta): kappa times the feature's share of its modality, plus floor."""
    s = counts.groupBy("modality", "feature").agg(F.sum("value").alias("s"))
    return s.select("modality", "feature", (kappa * F.col("s") / F.sum("s").over(Window.partitionBy("modality")) + floor).alias("beta"))


def covariate_codes(cells: DataFrame, column: str) -> DataFrame:
    """(column, code): codes from 0 in the labels' order."""
    labels = cells.select(column).distinct()  # one row for each category
    return labels.withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)


def sampled_features(counts: DataFrame, fraction: float, step: int, seed: int = 0) -> DataFrame:
    """(modality, feature, scale): max(1, int(fraction * G)) features of each modality in hashed order, scale G / n."""
    names = counts.select("modality", "feature").distinct()
    order = Window.partitionBy("modality").orderBy(F.xxhash64("feature", F.lit(step), F.lit(seed)), "feature")
    rows = names.withColumn("r", F.row_number().over(order)).withColumn("g", F.count("*").over(Window.partitionBy("modality")))
    n = F.greatest(F.lit(1), F.floor(F.col("g") * fraction))
    return rows.where(F.col("r") <= n).select("modality", "feature", (F.col("g") / n).alias("scale"))


# Patterns of coordinates and of stages in names.
PEAK, SPOT, STAGE = r"(chr[^:_]+)[:\-_](\d+)[:\-_](\d+)", r"^\d+x\d+$", r"(\d+\.\d+|\d+)"


def parse_coordinates(rows: DataFrame, column: str) -> DataFrame:
    """chrom, start, end of names like chr1:100-200 or chr1_100_200; x and y of names like 12x7."""
    part = lambda i: F.when(F.col(column).rlike(PEAK), F.regexp_extract(column, PEAK, i))
    spot = lambda i: F.when(F.col(column).rlike(SPOT), F.split(column, "x")[i].cast("int"))
    return rows.withColumns({"chrom": part(1), "start": part(2).cast("long"), "end": part(3).cast("long"), "x": spot(0), "y": spot(1)})


def parse_stage(rows: DataFrame, column: str) -> DataFrame:
    """The first number in a text, as a double."""
    return rows.withColumn("stage", F.regexp_extract(column, STAGE, 1).try_cast("double"))
