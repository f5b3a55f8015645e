"""Downstream evaluation: ranks, correlations, clustering agreement, silhouettes, neighbours' votes, derivatives along time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed
from . import medoid
from .graph import distance_sums, knn


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """rows with avg_rank, ties averaged. Distinct values are dealt into ranges, so that only the ranges' totals come together."""
    n = rows.groupBy(column).agg(F.count("*").alias("__n"))
    ranges = checkpointed(n.repartitionByRange(column).withColumn("__range", F.spark_partition_id()))
    totals = ranges.groupBy("__range").agg(F.sum("__n").alias("__total"))
    offset = totals.withColumn("__before", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__range", "__before")  # a row for each range
    below = F.coalesce(F.sum("__n").over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranges.join(F.broadcast(offset), "__range").withColumn("avg_rank", F.col("__before") + below + (F.col("__n") + 1) / 2.0).select(column, "avg_rank")
    return rows.join(ranked, column)


def percentile_rank(rows: DataFrame, column: str) -> DataFrame:
    """(average rank - 1) / (n - 1); 0 for a single row. Rows without a finite value are left out."""
    rows = rows.where(F.col(column).isNotNull())
    n = rows.count()
    return average_ranks(rows, column).withColumn("percentile", (F.col("avg_rank") - 1) / max(n - 1, 1)).drop("avg_rank")


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(x, y).alias("pearson"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, x).withColumnRenamed("avg_rank", "__x"), y)
    return ranked.agg(F.corr("__x", "avg_rank").alias("spearman"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").cast("double").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    t = contingency(rows, a, b)
    pairs = lambda df: df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"))
    sa, sb = t.groupBy("a").agg(F.sum("n").alias("n")), t.groupBy("b").agg(F.sum("n").alias("n"))
    one = pairs(t).withColumnRenamed("s", "s_ab").join(pairs(sa).withColumnRenamed("s", "s_a")).join(pairs(sb).withColumnRenamed("s", "s_b")).join(t.agg(F.sum("n").alias("n")))
    expected = F.col("s_a") * F.col("s_b") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("s_a") + F.col("s_b")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("s_ab") - expected) / F.when(top != expected, top - expected)).alias("ari"))


def normalized_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """With the arithmetic mean of both entropies."""
    t = contingency(rows, a, b)
    n = t.agg(F.sum("n").alias("total"))
    sa, sb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    mi = t.join(sa, "a").join(sb, "b").join(F.broadcast(n)).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("total") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    ent = lambda df, c, name: df.join(F.broadcast(n)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(name))
    mean = (F.col("ha") + F.col("hb")) / 2
    return mi.join(ent(sa, "na", "ha")).join(ent(sb, "nb", "hb")).select(F.when(mean > 0, F.col("mi") / F.when(mean > 0, mean)).otherwise(1.0).alias("nmi"))


def silhouette(points: DataFrame, label: str) -> DataFrame:
    """(silhouette): mean over cells of (b - a) / max(a, b); 0 for a label's only cell."""
    d = distance_sums(points, label).withColumn("d", F.col("s") / F.col("n"))
    near = d.groupBy("cell_id").agg(F.max(F.when(F.col("own") == F.col("label"), F.col("d"))).alias("in"), F.min(F.when(F.col("own") != F.col("label"), F.col("d"))).alias("out"))
    s = F.when(F.col("in").isNull(), 0.0).otherwise((F.col("out") - F.col("in")) / F.greatest("in", "out"))
    return near.agg(F.avg(s).alias("silhouette"))


def knn_accuracy(points: DataFrame, label: str, k: int = 5, metric: str = "cosine") -> DataFrame:
    """Accuracy and balanced accuracy of a vote of k neighbours; the test part is a fifth, by the first 32 bits of the id's md5."""
    points = points.withColumn("__test", F.conv(F.substring(F.md5(F.col("cell_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 == 0)
    near = knn(points.where("__test"), k, metric, points.where("not __test"))
    votes = near.join(points.select(F.col("cell_id").alias("dst"), F.col(label).alias("vote")), "dst").groupBy("src", "vote").agg(F.count("*").alias("n"))
    won = votes.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "vote"))).where("r = 1")
    hit = won.join(points.select(F.col("cell_id").alias("src"), F.col(label).alias("truth")), "src").select("truth", (F.col("vote") == F.col("truth")).cast("double").alias("hit"))
    return hit.agg(F.avg("hit").alias("accuracy")).join(hit.groupBy("truth").agg(F.avg("hit").alias("h")).agg(F.avg("h").alias("balanced_accuracy")))


def medoids(points: DataFrame, label: str) -> DataFrame:
    """(label, cell_id): the cell of each label with the smallest mean distance to the others of it.

    Pairs of cells are measured for labels where they are fewer than the products that bounds take for a cell.
    """
    sizes = points.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.max(F.size("point")).alias("width"))
    large = [r[0] for r in sizes.where((F.col("n") > 1) & (F.col("n") * F.col("width") > medoid.products(F.col("width")))).select(label).orderBy(label).collect()]
    few = points.where(~F.coalesce(F.col(label).isin(large), F.lit(False))) if large else points
    own = distance_sums(few, label, own=True).select(F.col("label").alias(label), "cell_id", F.round(F.col("s") / F.col("n"), 9).alias("m"))
    if large:
        own = own.unionByName(medoid.of_large(points, label, large))
    return own.groupBy(label).agg(F.min(F.struct("m", "cell_id")).getField("cell_id").alias("cell_id"))


def quantile_means(rows: DataFrame, group: str, time: str, value: str, low: float = 0.25, high: float = 0.75, min_rows: int = 10) -> DataFrame:
    """(group, early, late): means of value at times up to the low and from the high quantile, for groups large enough."""
    q = rows.groupBy(group).agg(F.percentile(time, low).alias("lo"), F.percentile(time, high).alias("hi"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    met = rows.join(q, group)
    return met.groupBy(group).agg(F.avg(F.when(F.col(time) <= F.col("lo"), F.col(value))).alias("early"), F.avg(F.when(F.col(time) >= F.col("hi"), F.col(value))).alias("late"))


def topic_change(theta: DataFrame, cells: DataFrame, group: str, time: str, min_rows: int = 10) -> DataFrame:
    """(group, k, change): late mean minus early mean of each topic's share."""
    q = cells.groupBy(group).agg(F.percentile(time, 0.25).alias("lo"), F.percentile(time, 0.75).alias("hi"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    side = cells.join(q, group).select("cell_id", group, (F.col(time) <= F.col("lo")).alias("early"), (F.col(time) >= F.col("hi")).alias("late"))
    sizes = side.groupBy(group).agg(F.sum(F.col("early").cast("int")).alias("ne"), F.sum(F.col("late").cast("int")).alias("nl"))
    sums = theta.join(side, "cell_id").groupBy(group, "k").agg(F.sum(F.when(F.col("early"), F.col("theta")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col("late"), F.col("theta")).otherwise(0.0)).alias("l"))
    return sums.join(sizes, group).select(group, "k", (F.col("l") / F.col("nl") - F.col("e") / F.col("ne")).alias("change"))


def feature_derivatives(change: DataFrame, phi: DataFrame, group: str) -> DataFrame:
    """(group, modality, feature, derivative): topic changes through phi."""
    return change.join(phi, "k").groupBy(group, "modality", "feature").agg(F.sum(F.col("change") * F.col("phi")).alias("derivative"))


def driver_features(derivatives: DataFrame, group: str, n: int = 10) -> DataFrame:
    """The n largest rises and falls of each group and modality, ranked from 1, ties by name."""
    own = Window.partitionBy(group, "modality")
    d = F.round("derivative", 9)
    rows = derivatives.withColumn("up", F.row_number().over(own.orderBy(F.desc(d), "feature"))).withColumn("down", F.row_number().over(own.orderBy(d, "feature")))
    up = rows.where(F.col("up") <= n).select(group, "modality", F.lit("up").alias("direction"), F.col("up").alias("rank"), "feature", "derivative")
    return up.unionByName(rows.where(F.col("down") <= n).select(group, "modality", F.lit("down").alias("direction"), F.col("down").alias("rank"), "feature", "derivative"))


def binned(rows: DataFrame, time: str, value: str, bins: int, low: float = 0.0, high: float = 1.0, include_last: bool = True) -> DataFrame:
    """(bin, mean, sem, n) over equal-width bins from 0; sem with ddof 0. Without include_last the top value is out."""
    b = F.floor((F.col(time) - low) / ((high - low) / bins)).cast("int")
    rows = rows.withColumn("bin", F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)) if include_last else b)
    if not include_last:
        rows = rows.where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.groupBy("bin").agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


def bin_changes(rows: DataFrame, time: str, value: str, bins: int) -> DataFrame:
    """(bin, change): a bin's mean minus that of the bin before it."""
    b = binned(rows, time, value, bins)
    before = b.select((F.col("bin") + 1).alias("bin"), F.col("mean").alias("was"))
    return b.join(before, "bin").select("bin", (F.col("mean") - F.col("was")).alias("change"))


def pivot_mean(rows: DataFrame, index: str, column: str, value: str, names: list) -> DataFrame:
    return rows.groupBy(index).pivot(column, names).agg(F.avg(value))


def f1_scores(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row (f1_macro, f1_weighted): over labels that occur as one or the other, plainly or weighted by their rows."""
    both = F.explode(F.array(F.struct(F.col(label).alias("of"), F.lit(1).alias("real"), F.lit(0).alias("said"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("of"), F.lit(0).alias("real"), F.lit(1).alias("said"), F.lit(0).alias("hit"))))
    each = rows.select(both.alias("x")).groupBy("x.of").agg(*[F.sum(f"x.{c}").alias(c) for c in ("real", "said", "hit")])
    f1 = 2 * F.col("hit") / (F.col("real") + F.col("said"))
    return each.agg(F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("real")) / F.sum("real")).alias("f1_weighted"))


def forest_scores(points: DataFrame, label: str, folds: int = 5, trees: int = 100, seed: int = 0) -> DataFrame:
    """(fold, f1_macro, f1_weighted): random forests on (cell_id, point, label), each judged on the fold that it has not seen.

    A cell's fold follows from a hash of its id. The label is a whole number from 0 on.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = points.select("cell_id", array_to_vector(F.col("point").cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(folds)).alias("fold"))
    out = None
    for fold in range(folds):
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows.where(F.col("fold") != fold))
        one = f1_scores(model.transform(rows.where(F.col("fold") == fold)), "label", "prediction").select(F.lit(fold).alias("fold"), "f1_macro", "f1_weighted")
        out = one if out is None else out.unionByName(one)
    return out
