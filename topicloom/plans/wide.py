"""Queries of wide factorisations, local regressions and keyed streams, and the SQL that says the same."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.lineage import Written, shared_dir
from ..operators import range_finder as R
from ..operators import variable_features as V
from ..streaming import keyed_cells as S
from . import proxies as X
from .catalogue import _n, _query, rounded

_FITS = """, lm AS (SELECT modality, feature, mean, v1 AS var, log10(mean) AS x, log10(v1) AS y, row_number() OVER (PARTITION BY modality ORDER BY log10(mean), feature) - 1 AS r, count(*) OVER (PARTITION BY modality) AS n
  FROM (SELECT *, var * (SELECT c FROM nc) / ((SELECT c FROM nc) - 1) AS v1 FROM mom) WHERE mean > 0 AND v1 > 1e-12 * mean * mean),
vt AS (SELECT DISTINCT modality, x AS v FROM lm JOIN (SELECT unnest(range(18)) AS j) ON r = (j * (n - 1)) // 17),
en AS (SELECT a.modality, a.x AS low, b.x AS high FROM lm a JOIN lm b ON b.modality = a.modality AND b.r = a.r + least(a.n, greatest(CAST(floor(a.n * 0.3e0) AS BIGINT), 4)) - 1),
bw AS (SELECT modality, v, min(greatest(v - low, high - v)) AS h FROM vt JOIN en USING (modality) GROUP BY ALL),
nb AS (SELECT modality, v, h, CASE WHEN h > 0 THEN (x - v) / h ELSE 0 END AS u, y FROM lm JOIN bw USING (modality) WHERE abs(x - v) < h OR x = v),
sm AS (SELECT modality, v, h, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM (SELECT *, pow(1 - pow(abs(u), 3), 3) AS w FROM nb) GROUP BY ALL),
dt AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS d3, s0 * s2 - s1 * s1 AS d2 FROM sm),
vf AS (SELECT modality, v, CASE WHEN d3 > 1e-9 * s0 * s0 * s0 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / d3 WHEN d2 > 1e-9 * s0 * s0 THEN (t0 * s2 - s1 * t1) / d2 ELSE t0 / s0 END AS f,
  CASE WHEN d3 > 1e-9 * s0 * s0 * s0 THEN (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / d3 / h WHEN d2 > 1e-9 * s0 * s0 THEN (s0 * t1 - s1 * t0) / d2 / h ELSE 0 END AS g FROM dt),
pc AS (SELECT modality, v AS low, lead(v) OVER w AS high, f AS f0, g AS g0, lead(f) OVER w AS f1, lead(g) OVER w AS g1 FROM vf WINDOW w AS (PARTITION BY modality ORDER BY v)),
tr AS (SELECT modality, feature, mean, var, coalesce((1 + 2 * t) * (1 - t) * (1 - t) * f0 + t * (1 - t) * (1 - t) * (high - low) * g0 + t * t * (3 - 2 * t) * f1 + t * t * (t - 1) * (high - low) * g1, f0) AS trend
  FROM (SELECT lm.*, pc.low, pc.high, f0, g0, f1, g1, (x - pc.low) / (pc.high - pc.low) AS t FROM lm JOIN pc ON pc.modality = lm.modality AND x >= pc.low AND (pc.high IS NULL OR x < pc.high))),
sc AS (SELECT modality, feature, trend, ((SELECT c FROM nc) * mean * mean + sum(c * c) - 2 * mean * sum(c)) / (((SELECT c FROM nc) - 1) * pow(10e0, trend)) AS score
  FROM (SELECT tr.*, least(x.value, tr.mean + sqrt(pow(10e0, trend)) * sqrt((SELECT c FROM nc))) AS c FROM tr JOIN x USING (modality, feature)) GROUP BY modality, feature, mean, trend)
"""


@_query(_FITS + "SELECT modality, feature, rank, round(trend, 4) AS trend, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY round(score, 6) DESC, feature) AS rank FROM sc) WHERE rank <= 10")
def loess_variable_features(spark, d):
    return rounded(V.loess_hvg(X.counts(spark, d), _n(spark, d), 10).select("modality", "feature", "rank", "trend", "score"), 4)


@_query("""SELECT modality, feature, j, round(sum(value * s), 3) + 0e0 AS z FROM x JOIN (SELECT cell_id, j, sum(value * y) AS s FROM x JOIN
 (SELECT modality, feature, j, (i * 7 + j * 3) % 5 - 2 AS y FROM (SELECT modality, feature, row_number() OVER (ORDER BY modality, feature) - 1 AS i FROM (SELECT DISTINCT modality, feature FROM x)), (SELECT unnest(range(3)) AS j)) USING (modality, feature)
 GROUP BY cell_id, j) USING (cell_id) GROUP BY modality, feature, j""")
def subspace_step(spark, d):
    """X' X times three columns given by formula: a round of the range finder without its orthonormal bases."""
    data = X.bundle(spark, d)
    names = Written(spark, "features").put(data.features().select("modality", "feature", F.col("global_idx").alias("i")))
    entries = data.counts.join(names, ["modality", "feature"]).select("cell_id", "i", "value")
    y = names.select("i", F.array(*[((F.col("i") * 7 + j * 3) % 5 - 2).cast("double") for j in range(3)]).alias("y"))
    z = R.product(entries, "i", R.product(entries, "cell_id", y, 3), 3)
    return z.join(names, "i").select("modality", "feature", F.posexplode("y").alias("j", "z")).withColumn("z", F.round("z", 3) + 0.0)


@_query(None)
def wide_pca(spark, d):
    """The principal components of the exact query, without its matrix of components by components."""
    return rounded(R.principal_components(X.embedding_cells(spark, d).select("cell_id", "point"), 10, tolerance=1e-4).select("cell_id", F.posexplode("scores").alias("component", "score")), 3)


@_query(None)
def wide_lsi(spark, d):
    """The scores of the exact query, without its matrix of features by features."""
    data = X.bundle(spark, d)
    return rounded(R.semantic_index(data.counts, data.features(), data.cells.count(), 10, tolerance=1e-4).select("cell_id", F.posexplode("scores").alias("component", "score")), 3)


@_query(""", fi AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT feature FROM x WHERE modality = 'rna')),
lw AS (SELECT cell_id, i, k, coalesce(value, 0) * ([0e0, 1e0, 1.5e0][1 + (i + k) % 3] - ln(1 + (2 * i + k) % 4 / 2e0)) - (1 + (i + k) % 3) / (1 + (2 * i + k) % 4 / 2e0) AS w
  FROM ce CROSS JOIN fi CROSS JOIN (SELECT unnest(range(3)) AS k) LEFT JOIN x USING (cell_id, feature)),
ex AS (SELECT cell_id, i, k, exp(w - max(w) OVER (PARTITION BY cell_id, i)) AS e FROM lw), rh AS (SELECT cell_id, k, e / sum(e) OVER (PARTITION BY cell_id, i) AS r FROM ex)
SELECT cell_id, deliveries, k, round(0.1e0 + sum(r), 5) AS gamma FROM rh JOIN (SELECT o_custkey AS cell_id, count(DISTINCT l_orderkey) AS deliveries FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (cell_id) GROUP BY cell_id, deliveries, k""")
def streamed_cell_topics(spark, d):
    """Each order is a delivery of its customer's counts; the stream's keyed state adds them up, in several batches.

    Rates by formula, of whole shapes 1 to 3; one round from equal topics.
    """
    base = Written(spark, "ordered").put(X.lines(spark, d).groupBy("cell_id", "l_orderkey", "p_brand").agg(F.sum("q").alias("q")))
    used = sorted(r.p_brand for r in base.select("p_brand").distinct().collect())  # features
    index = spark.createDataFrame(list(enumerate(used)), "idx int, p_brand string")
    rows = base.join(index, "p_brand").groupBy("cell_id", F.col("l_orderkey").alias("delivery")).agg(F.collect_list(F.struct("idx", F.col("q").alias("val"))).alias("e")).select("cell_id", "delivery", F.col("e.idx").alias("idx"), F.col("e.val").alias("val"))
    source = Written(spark, "deliveries")
    files = len(source.put(rows).inputFiles())
    i, k = np.arange(len(used))[:, None], np.arange(3)
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    got = S.run_available(spark, source.path, f"{at}/sink", f"{at}/checkpoint", 1.0 + (i + k) % 3, 1 + (2 * i + k) % 4 / 2, files_per_batch=max(1, -(-files // 3)), inner_iters=1)
    return rounded(got.select("cell_id", "deliveries", F.posexplode("gamma").alias("k", "gamma")), 5)
