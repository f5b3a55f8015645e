"""The registered queries: each operator over the test tables' proxy matrices, with the SQL that says the same."""

from __future__ import annotations

from functools import wraps

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import factors as FA
from ..operators import graph as G
from ..operators import likelihood as L
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import priors as PR
from ..operators import summaries as S
from ..sources import bundle as B
from . import proxies as X

_FX = """
WITH base AS (SELECT o_custkey AS cell_id, p_brand, p_type, l_suppkey, concat(l_returnflag, l_linestatus) AS flag, CAST(l_quantity AS DOUBLE) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
x AS (SELECT cell_id, 'rna' AS modality, p_brand AS feature, sum(q) AS value FROM base GROUP BY cell_id, p_brand
  UNION ALL SELECT cell_id, 'protein', flag, CAST(count(*) AS DOUBLE) FROM base GROUP BY cell_id, flag
  UNION ALL SELECT DISTINCT cell_id, 'chromatin', CAST(l_suppkey AS VARCHAR), CAST(1 AS DOUBLE) FROM base),
kk AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM base)),
th AS (SELECT cell_id, k, q / sum(q) OVER (PARTITION BY cell_id) AS theta FROM (SELECT cell_id, k, sum(q) AS q FROM base JOIN kk USING (p_type) GROUP BY cell_id, k)),
ph AS (SELECT modality, k, feature, w / sum(w) OVER (PARTITION BY modality, k) AS phi FROM (
  SELECT 'rna' AS modality, k, p_brand AS feature, sum(q) AS w FROM base JOIN kk USING (p_type) GROUP BY k, p_brand
  UNION ALL SELECT 'protein', k, flag, CAST(count(*) AS DOUBLE) FROM base JOIN kk USING (p_type) GROUP BY k, flag)),
ce AS (SELECT c_custkey AS cell_id, row_number() OVER (ORDER BY c_custkey) - 1 AS cell_idx, c_mktsegment AS batch, c_nationkey AS label FROM customer WHERE c_custkey IN (SELECT cell_id FROM base)),
nc AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM ce),
ed AS (SELECT DISTINCT a.cell_id AS src, b.cell_id AS dst, CAST(1 AS DOUBLE) AS weight FROM ce a JOIN ce b ON b.cell_idx = (a.cell_idx + 1) % (SELECT CAST(c AS BIGINT) FROM nc)
  UNION SELECT DISTINCT b.cell_id, a.cell_id, CAST(1 AS DOUBLE) FROM ce a JOIN ce b ON b.cell_idx = (a.cell_idx + 1) % (SELECT CAST(c AS BIGINT) FROM nc)),
lib AS (SELECT c.cell_id, m.modality, coalesce(s.lib, 0) AS lib FROM ce c CROSS JOIN (SELECT DISTINCT modality FROM x) m LEFT JOIN (SELECT cell_id, modality, sum(value) AS lib FROM x GROUP BY ALL) s ON s.cell_id = c.cell_id AND s.modality = m.modality),
mom AS (SELECT modality, feature, sum(value) / (SELECT c FROM nc) AS mean, sum(value * value) / (SELECT c FROM nc) - (sum(value) / (SELECT c FROM nc)) * (sum(value) / (SELECT c FROM nc)) AS var FROM x GROUP BY ALL),
rt AS (SELECT x.cell_id, x.modality, x.feature, x.value, sum(theta * coalesce(phi, 0)) AS rate FROM x JOIN th USING (cell_id) LEFT JOIN ph ON ph.modality = x.modality AND ph.k = th.k AND ph.feature = x.feature WHERE x.modality <> 'chromatin' GROUP BY ALL),
gr AS (SELECT g.cell_id, g.modality, g.feature, g.rate, coalesce(x.value, 0) AS value FROM (SELECT cell_id, modality, feature, sum(theta * phi) AS rate FROM th JOIN ph USING (k) GROUP BY ALL) g LEFT JOIN x ON x.cell_id = g.cell_id AND x.modality = g.modality AND x.feature = g.feature),
df AS (SELECT doc_id, lang FROM documents),
em AS (SELECT vec_id AS cell_id, embedding AS point, label FROM embeddings),
ds AS (SELECT a.cell_id AS a, b.cell_id AS b, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(range(1, len(a.point) + 1), lambda i: (CAST(a.point[i] AS DOUBLE) - CAST(b.point[i] AS DOUBLE)) * (CAST(a.point[i] AS DOUBLE) - CAST(b.point[i] AS DOUBLE))))) AS d FROM em a JOIN em b ON a.cell_id <> b.cell_id),
tm AS (SELECT cell_id, label, batch, date_diff('day', TIMESTAMP '1990-01-01', CAST(t AS TIMESTAMP)) AS day FROM ce JOIN (SELECT o_custkey AS cell_id, min(o_orderdate) AS t FROM orders GROUP BY 1) o USING (cell_id)),
rk AS (SELECT tm.*, (rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0::DOUBLE - 1) / ((SELECT c FROM nc) - 1) AS pct FROM tm)
"""

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, fx: bool = True):
    def register(f):
        @wraps(f)
        def query(spark, d):
            with X.shared():
                return f(spark, d)

        _QUERIES[f.__name__] = query
        if sql:
            _SQL[f.__name__] = (_FX if fx else "") + sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def _n(spark, d) -> int:
    return X.cells(spark, d).count()


def _numeric(spark, d) -> DataFrame:
    """Counts of rna and protein: the modalities that phi covers."""
    return P.select_modalities(X.counts(spark, d), ["rna", "protein"])


def _times(spark, d) -> DataFrame:
    first = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.min("o_orderdate").alias("t"))
    return X.cells(spark, d).join(first, "cell_id").select("cell_id", "label", "batch", F.datediff("t", F.lit("1990-01-01").cast("date")).cast("double").alias("day"))


def _ranked(spark, d) -> DataFrame:
    return E.percentile_rank(_times(spark, d), "day").withColumnRenamed("percentile", "pct")


@_query("SELECT modality, feature, cell_id, round(value, 6) AS value FROM x")
def extract_concat(spark, d):
    return rounded(B.TopicData.from_counts(X.counts(spark, d)).counts.select("modality", "feature", "cell_id", "value"))


@_query("SELECT modality, feature, cell_id, round(value, 6) AS value FROM x WHERE modality IN ('rna', 'protein')")
def modality_subset(spark, d):
    return rounded(B.TopicData.from_counts(X.counts(spark, d), modalities=["rna", "protein"]).counts.select("modality", "feature", "cell_id", "value"))


@_query("SELECT modality, feature, cell_id, round(value * 2, 6) AS value FROM x WHERE modality = 'rna'")
def layer_select(spark, d):
    c = X.counts(spark, d)
    both = c.withColumn("layer", F.lit("counts")).unionByName(c.withColumn("value", F.col("value") * 2).withColumn("layer", F.lit("double")))
    return rounded(B.TopicData.from_counts(both, modalities=["rna"], layer="double").counts.select("modality", "feature", "cell_id", "value"))


@_query("SELECT modality, feature, row_number() OVER (PARTITION BY modality ORDER BY feature) - 1 AS feature_idx, row_number() OVER (ORDER BY modality, feature) - 1 AS global_idx FROM (SELECT DISTINCT modality, feature FROM x)")
def global_feature_index(spark, d):
    return rounded(B.TopicData.from_counts(X.counts(spark, d)).features())


@_query("SELECT cell_id, modality, feature, CAST(1 AS DOUBLE) AS value FROM x WHERE value > 0")
def binarize(spark, d):
    return P.binarize(X.counts(spark, d)).select("cell_id", "modality", "feature", "value")


@_query("SELECT cell_id, modality, feature, round(value - 3, 6) AS value FROM x WHERE modality = 'protein' AND feature IN (SELECT feature FROM x WHERE modality = 'protein' GROUP BY feature HAVING sum(value - 3) > 0)")
def drop_zero_features(spark, d):
    c = X.counts(spark, d).where("modality = 'protein'").withColumn("value", F.col("value") - 3)
    return rounded(P.drop_zero_features(c).select("cell_id", "modality", "feature", "value"))


@_query("""SELECT cell_id, modality, feature, round(value, 6) AS value FROM x WHERE (modality, feature) IN (SELECT (modality, feature) FROM x GROUP BY modality, feature HAVING sum(value) >= 100 AND count(*) >= 20)
 AND cell_id IN (SELECT cell_id FROM x WHERE (modality, feature) IN (SELECT (modality, feature) FROM x GROUP BY modality, feature HAVING sum(value) >= 100 AND count(*) >= 20) GROUP BY cell_id HAVING count(*) >= 10)""")
def filter_genes_cells(spark, d):
    return rounded(P.filter_cells(P.filter_features(X.counts(spark, d), 100, 20), 10).select("cell_id", "modality", "feature", "value"))


@_query("SELECT modality, feature, rank, round(var, 4) AS var FROM (SELECT modality, feature, var, row_number() OVER (PARTITION BY modality ORDER BY round(var, 6) DESC, feature) AS rank FROM mom) WHERE rank <= 5")
def top_variance_features(spark, d):
    return rounded(P.top_variance_features(X.counts(spark, d), _n(spark, d), 5), 4)


@_query("""SELECT modality, feature, rank, round(norm, 4) AS norm FROM (SELECT modality, feature, norm, row_number() OVER (PARTITION BY modality ORDER BY round(norm, 9) DESC, feature) AS rank FROM
 (SELECT modality, feature, coalesce(CASE WHEN stddev_samp(d) OVER w > 0 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w END, 0) AS norm FROM (SELECT *, var / mean AS d, ntile(5) OVER (PARTITION BY modality ORDER BY round(mean, 9), feature) AS bin FROM mom WHERE mean > 0) WINDOW w AS (PARTITION BY modality, bin))) WHERE rank <= 10""")
def highly_variable_features(spark, d):
    return rounded(P.dispersion_hvg(X.counts(spark, d), _n(spark, d), 10, 5).select("modality", "feature", "rank", "norm"), 4)


@_query("SELECT cell_id, modality, feature, round(ln(1 + value / lib * 10000), 6) AS value FROM x JOIN lib USING (cell_id, modality)")
def normalize_log1p(spark, d):
    return rounded(P.normalize_log1p(X.counts(spark, d)).select("cell_id", "modality", "feature", "value"))


@_query("SELECT cell_id, modality, feature, round(CASE WHEN var > 0 THEN (value - mean) / sqrt(var * (SELECT c FROM nc) / ((SELECT c FROM nc) - 1)) ELSE 0 END, 5) AS value, round(CASE WHEN var > 0 THEN -mean / sqrt(var * (SELECT c FROM nc) / ((SELECT c FROM nc) - 1)) ELSE 0 END, 5) AS zero FROM x JOIN mom USING (modality, feature)")
def scale_features(spark, d):
    return rounded(P.scale_features(X.counts(spark, d), _n(spark, d)).select("cell_id", "modality", "feature", "value", "zero"), 5)


@_query("SELECT cell_id, modality, feature, round(ln(1 + value / greatest(lib, 1) * mid), 6) AS value FROM x JOIN lib USING (cell_id, modality) JOIN (SELECT modality, quantile_disc(lib, 0.5) AS mid FROM lib GROUP BY modality) USING (modality)")
def median_depth_log1p(spark, d):
    return rounded(P.median_depth_log1p(X.counts(spark, d), X.cells(spark, d)).select("cell_id", "modality", "feature", "value"))


@_query("SELECT cell_id, modality, feature, round_even(greatest(value / 4 - 1, 0), 0) AS value FROM x")
def clamp_round(spark, d):
    return P.clamp_round(X.counts(spark, d).withColumn("value", F.col("value") / 4 - 1)).select("cell_id", "modality", "feature", "value")


@_query("SELECT cell_id, modality, round(lib, 6) AS lib FROM lib")
def library_size(spark, d):
    return rounded(P.library_sizes(X.counts(spark, d), X.cells(spark, d)))


@_query("SELECT cell_id, modality, CAST(lib > 0 AS BIGINT) AS present FROM lib")
def presence_mask(spark, d):
    return rounded(P.presence(X.counts(spark, d), X.cells(spark, d)))


@_query("SELECT modality, feature, round(ln(sum(value / lib) / (SELECT c FROM nc) + 1e-15), 6) AS background FROM x JOIN lib USING (cell_id, modality) GROUP BY ALL")
def feature_background(spark, d):
    return rounded(P.feature_background(X.counts(spark, d), _n(spark, d)))


@_query("""SELECT modality, round(m * m / v, 5) AS gamma, round(m / v, 5) AS tau FROM (SELECT modality, s / n AS m, greatest(q / n - (s / n) * (s / n), 1e-6) AS v FROM
 (SELECT modality, sum(value) AS s, sum(value * value) AS q, count(DISTINCT feature) * (SELECT c FROM nc) AS n FROM x GROUP BY modality))""")
def eb_prior_scalar(spark, d):
    return rounded(P.scalar_prior(X.counts(spark, d), _n(spark, d)), 5)


@_query("SELECT modality, feature, round(mean * mean / greatest(var, 1e-6), 5) AS shape, round(mean / greatest(var, 1e-6), 5) AS rate FROM mom")
def eb_prior_gene(spark, d):
    return rounded(P.gene_prior(X.counts(spark, d), _n(spark, d)), 5)


@_query("SELECT modality, feature, round(s / sum(s) OVER (PARTITION BY modality) + 1e-3, 6) AS beta FROM (SELECT modality, feature, sum(value) AS s FROM x GROUP BY ALL)")
def eb_prior_dirichlet(spark, d):
    return rounded(P.dirichlet_prior(X.counts(spark, d)))


@_query("SELECT cell_id, CAST(3 - count(DISTINCT modality) AS BIGINT) AS missing FROM x WHERE NOT (modality = 'protein' AND cell_id % 7 = 0) GROUP BY cell_id HAVING count(DISTINCT modality) < 3")
def cell_alignment_check(spark, d):
    return B.misaligned_cells(X.counts(spark, d).where("not (modality = 'protein' and cell_id % 7 = 0)"))


@_query("SELECT modality, count(*) AS n FROM x WHERE value NOT IN (0, 1) GROUP BY modality")
def nonbinary_values(spark, d):
    return B.value_checks(X.counts(spark, d)).where("not_binary > 0").select("modality", F.col("not_binary").alias("n"))


@_query("SELECT batch, dense_rank() OVER (ORDER BY batch) - 1 AS code FROM (SELECT DISTINCT batch FROM ce)")
def covariate_codes(spark, d):
    return rounded(P.covariate_codes(X.cells(spark, d), "batch"))


@_query("SELECT DISTINCT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id", fx=False)
def obs_intersection(spark, d):
    return X.table(spark, d, "documents").select("doc_id").intersect(X.table(spark, d, "labels").select("doc_id"))


@_query("""SELECT user_id AS cell_id, event_type AS feature, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL""", fx=False)
def wide_matrix_melt(spark, d):
    e = X.table(spark, d, "events")
    names = sorted(r[0] for r in e.select("event_type").distinct().collect())
    return B.wide_to_long(e.groupBy("user_id").pivot("event_type", names).count().na.fill(0), "user_id")


@_query("SELECT p_name AS name, 'chr' || CAST(p_partkey % 23 AS VARCHAR) AS chrom, CAST(p_partkey AS BIGINT) AS \"start\", CAST(p_partkey + 500 AS BIGINT) AS \"end\", CAST(7.5 AS DOUBLE) AS stage FROM part", fx=False)
def parse_names(spark, d):
    rows = X.table(spark, d, "part").select(F.col("p_name").alias("name"), F.expr("concat('chr', p_partkey % 23, ':', p_partkey, '-', p_partkey + 500)").alias("peak"), F.lit("E7.5").alias("day"))
    return P.parse_stage(P.parse_coordinates(rows, "peak"), "day").select("name", "chrom", "start", "end", "stage")


@_query("SELECT cell_id, round(-sum(t * ln(greatest(t, 1e-8))), 6) AS entropy FROM (SELECT cell_id, theta / (sum(theta) OVER (PARTITION BY cell_id) + 1e-12) AS t FROM th) GROUP BY cell_id")
def cell_entropy(spark, d):
    return rounded(M.cell_entropy(X.theta(spark, d)))


@_query("SELECT round(avg(e), 6) AS mean_entropy FROM (SELECT -sum(t * ln(greatest(t, 1e-8))) AS e FROM (SELECT cell_id, theta / (sum(theta) OVER (PARTITION BY cell_id) + 1e-12) AS t FROM th) GROUP BY cell_id)")
def mean_entropy(spark, d):
    return rounded(M.mean_entropy(X.theta(spark, d)))


_COS = """, un AS (SELECT modality, k, feature, phi / (sqrt(sum(phi * phi) OVER (PARTITION BY modality, k)) + 1e-12) AS u FROM ph),
co AS (SELECT p.modality, p.k, p.l, coalesce(sum(a.u * b.u), 0) AS cosine FROM (SELECT DISTINCT a.modality, a.k, b.k AS l FROM ph a JOIN ph b ON a.modality = b.modality AND a.k < b.k) p
 LEFT JOIN un a ON a.modality = p.modality AND a.k = p.k LEFT JOIN un b ON b.modality = p.modality AND b.k = p.l AND b.feature = a.feature GROUP BY ALL)
"""


@_query(_COS + "SELECT modality, k, l, round(cosine, 6) AS cosine FROM co")
def topic_cosines(spark, d):
    return rounded(M.topic_cosines(X.phi(spark, d)))


@_query(_COS + "SELECT modality, round(1 - avg(cosine), 6) AS diversity FROM co GROUP BY modality")
def topic_diversity(spark, d):
    return rounded(M.topic_diversity(X.phi(spark, d)))


@_query(_COS + "SELECT round(avg(v), 6) AS diversity FROM (SELECT 1 - avg(cosine) AS v FROM co GROUP BY modality)")
def topic_diversity_all(spark, d):
    return rounded(M.mean_topic_diversity(X.phi(spark, d)))


@_query("SELECT modality, k, rank, feature, round(phi, 6) AS phi FROM (SELECT *, row_number() OVER (PARTITION BY modality, k ORDER BY round(phi, 9) DESC, feature) AS rank FROM ph) WHERE rank <= 10")
def top_features(spark, d):
    return rounded(M.top_features(X.phi(spark, d), 10))


@_query("SELECT modality, k, max(CASE WHEN r = 1 THEN feature END) AS rank_1, max(CASE WHEN r = 2 THEN feature END) AS rank_2, max(CASE WHEN r = 3 THEN feature END) AS rank_3 FROM (SELECT *, row_number() OVER (PARTITION BY modality, k ORDER BY round(phi, 9) DESC, feature) AS r FROM ph) GROUP BY modality, k")
def top_features_wide(spark, d):
    return rounded(M.top_features_wide(X.phi(spark, d), 3))


@_query("""SELECT feature_a, feature_b, round(score / max(score) OVER (), 6) AS score FROM (SELECT a.feature AS feature_a, b.feature AS feature_b, sum(s * a.p * b.p) AS score
 FROM (SELECT k, feature, phi / (sum(phi) OVER (PARTITION BY feature) + 1e-12) AS p FROM ph WHERE modality = 'rna') a
 JOIN (SELECT k, feature, phi / (sum(phi) OVER (PARTITION BY feature) + 1e-12) AS p FROM ph WHERE modality = 'protein') b USING (k)
 JOIN (SELECT k, sum(theta) / (SELECT c FROM nc) AS s FROM th GROUP BY k) USING (k) GROUP BY ALL)""")
def cross_modality(spark, d):
    return rounded(M.cross_modality(X.theta(spark, d), X.phi(spark, d), "rna", "protein"))


@_query("SELECT k, round((sum(theta * theta) - sum(theta) * sum(theta) / (SELECT c FROM nc)) / ((SELECT c FROM nc) - 1), 6) AS variance FROM th GROUP BY k")
def topic_variance(spark, d):
    return rounded(M.topic_variance(X.theta(spark, d)))


@_query("SELECT k, round(sum(theta) / (SELECT c FROM nc), 6) AS mean FROM th GROUP BY k")
def mean_topic(spark, d):
    return rounded(M.mean_topic(X.theta(spark, d)))


@_query("SELECT cell_id, modality, round(CAST(1 AS DOUBLE) / 3, 6) AS weight FROM lib")
def modality_weights_equal(spark, d):
    return rounded(M.modality_weights(P.presence(X.counts(spark, d), X.cells(spark, d))))


@_query("SELECT cell_id, modality, round(CASE modality WHEN 'rna' THEN exp(1e0) WHEN 'protein' THEN exp(0.5e0) ELSE 1 END / (exp(1e0) + exp(0.5e0) + 1), 6) AS weight FROM lib")
def modality_weights_universal(spark, d):
    return rounded(M.modality_weights(P.presence(X.counts(spark, d), X.cells(spark, d)), "universal", {"rna": 1.0, "protein": 0.5, "chromatin": 0.0}))


@_query("SELECT cell_id, modality, round(z / sum(z) OVER (PARTITION BY cell_id), 6) AS weight FROM (SELECT cell_id, modality, CASE WHEN modality = 'protein' AND cell_id % 7 = 0 THEN 0 WHEN modality = 'rna' THEN exp(1e0) WHEN modality = 'protein' THEN exp(0.5e0) ELSE 1 END AS z FROM lib)")
def modality_weights_cell(spark, d):
    c = X.counts(spark, d).where("not (modality = 'protein' and cell_id % 7 = 0)")
    return rounded(M.modality_weights(P.presence(c, X.cells(spark, d)), "cell", {"rna": 1.0, "protein": 0.5, "chromatin": 0.0}))


@_query("SELECT modality, round(sqrt(avg(f) OVER () / f), 6) AS weight FROM (SELECT modality, CAST(count(DISTINCT feature) AS DOUBLE) AS f FROM x GROUP BY modality)")
def likelihood_weights(spark, d):
    return rounded(M.likelihood_weights(X.bundle(spark, d).features(), "sqrt", "mean"))


@_query("SELECT k, count(*) AS cells, round(count(*) * 100e0 / (SELECT c FROM nc), 6) AS percent FROM (SELECT cell_id, k, row_number() OVER (PARTITION BY cell_id ORDER BY round(theta, 12) DESC, k) AS r FROM th) WHERE r = 1 GROUP BY k")
def dominant_topic(spark, d):
    return rounded(M.dominant_counts(X.theta(spark, d)))


@_query("SELECT cell_id, k, round(sqrt(theta), 6) AS root FROM th")
def hellinger_theta(spark, d):
    return rounded(M.hellinger(X.theta(spark, d)))


@_query("SELECT modality, k, feature, round(sum(theta * value), 4) AS n FROM x JOIN th USING (cell_id) GROUP BY ALL")
def topic_feature_counts(spark, d):
    return rounded(M.topic_feature_counts(X.counts(spark, d), X.theta(spark, d)), 4)


@_query("SELECT label, k, round(sum(theta) / any_value(n), 6) AS mean FROM th JOIN ce USING (cell_id) JOIN (SELECT label, count(*) AS n FROM ce GROUP BY label) USING (label) GROUP BY label, k")
def theta_by_group(spark, d):
    return rounded(M.theta_by_group(X.theta(spark, d), X.cells(spark, d), "label"))


@_query("""SELECT cell_id, i, round(ln(a) - avg(ln(a)) OVER w, 6) AS mu, round(sqrt((1 - 2e0 / 3) / a + sum(1 / a) OVER w / 9), 6) AS sigma
 FROM (SELECT o_orderkey AS cell_id, i, 0.1e0 * (1 + (o_orderkey + i) % 7) AS a FROM orders CROSS JOIN (SELECT unnest(range(3)) AS i)) WINDOW w AS (PARTITION BY cell_id)""", fx=False)
def logistic_normal_params(spark, d):
    """The logistic-normal of three concentrations for each order."""
    alpha = F.array(*[0.1 * (1 + (F.col("o_orderkey") + i) % 7) for i in range(3)])
    return rounded(M.logistic_normal_rows(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), alpha.alias("alpha")), "cell_id", "alpha"))


@_query("SELECT cell_id, round(sqrt(t1 * t1 * s / (t1 * t1 + s + 1e-8)), 6) AS multiplier FROM (SELECT o_orderkey AS cell_id, 1.5e0 AS t1, pow(0.1e0 * (o_orderkey % 7 + 1) * (o_orderkey % 5 + 1), 2) AS s FROM orders)", fx=False)
def horseshoe_multiplier(spark, d):
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.lit(1.5).alias("caux"), F.lit(0.1).alias("tau"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("delta"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("lam"))
    return rounded(M.horseshoe(rows).select("cell_id", "multiplier"))


@_query("SELECT cell_id, round(sum(w * mu), 6) AS mean, round(greatest(sum(w * v) + sum(w * mu * mu) - sum(w * mu) * sum(w * mu), 1e-5), 6) AS var FROM (SELECT cell_id, 1e0 / 3 AS w, ln(1 + lib) AS mu, 0.1e0 + 1 / (1 + lib) AS v FROM lib) GROUP BY cell_id")
def mixture_gaussians(spark, d):
    rows = P.library_sizes(X.counts(spark, d), X.cells(spark, d)).select("cell_id", (F.lit(1.0) / 3).alias("weight"), F.log1p("lib").alias("mu"), (0.1 + 1 / (1 + F.col("lib"))).alias("v"))
    return rounded(M.mixture_of_gaussians(rows, "cell_id"))


@_query("SELECT modality, round(sum(value * ln(rate + 1e-8)), 3) AS ll FROM rt GROUP BY modality")
def ll_multinomial(spark, d):
    return rounded(L.multinomial(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d)), 3)


@_query("SELECT modality, round(sum(value * ln(rate + 1e-8) - rate - 1e-8 - lgamma(value + 1)), 3) AS ll FROM gr GROUP BY modality")
def ll_poisson(spark, d):
    return rounded(L.poisson(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d), constant=True), 3)


_NB = """, nb AS (SELECT gr.modality, value, {r} AS r, greatest(rate * lib, 1e-8) AS mu FROM gr JOIN lib USING (cell_id, modality))
SELECT modality, round(sum(lgamma(value + r) - lgamma(r) - lgamma(value + 1) + r * ln(r / (r + mu)) + value * ln(mu / (r + mu))), 3) AS ll FROM nb GROUP BY modality"""


@_query(_NB.format(r="1e0"))
def ll_nb(spark, d):
    return rounded(L.negative_binomial(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d)), 3)


@_query(_NB.format(r="(1 / (0.5e0 * 0.5e0 + 1e-8))"))
def ll_gamma_poisson(spark, d):
    return rounded(L.gamma_poisson(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d), 0.5), 3)


@_query(""", pr AS (SELECT gr.modality, least(value, 1) AS b, greatest(least(rate * lib / m, 1 - 1e-7), 1e-7) AS p FROM gr JOIN lib USING (cell_id, modality) JOIN (SELECT modality, sum(lib) / (SELECT c FROM nc) AS m FROM lib GROUP BY modality) USING (modality))
SELECT modality, round(sum(b * ln(p) + (1 - b) * ln(1 - p)), 3) AS ll FROM pr GROUP BY modality""")
def ll_bernoulli(spark, d):
    return rounded(L.bernoulli(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d)), 3)


@_query("SELECT modality, round(sum(least(value, 1) * ln(p) + (1 - least(value, 1)) * ln(1 - p)), 3) AS ll FROM (SELECT *, greatest(least(rate, 1 - 1e-12), 1e-12) AS p FROM gr) GROUP BY modality")
def ll_bernoulli_sharetopic(spark, d):
    return rounded(L.bernoulli_plain(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d)), 3)


@_query(""", v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), s AS (SELECT i, stddev_pop(x) AS s FROM v GROUP BY i)
SELECT round(sum(-0.5e0 * pow((x - m) / s, 2) - ln(s) - 0.9189385332046727e0), 3) AS ll FROM v JOIN m USING (label, i) JOIN s USING (i)""")
def ll_gaussian(spark, d):
    v = X.embedding_cells(spark, d).select("cell_id", "label", F.posexplode("point").alias("feature", "value"))
    means = v.groupBy("label", "feature").agg(F.avg("value").alias("mean"))
    means = v.select("cell_id", "label", "feature").join(means, ["label", "feature"]).select("cell_id", "feature", "mean")
    return rounded(L.gaussian(v.select("cell_id", "feature", "value"), means, v.groupBy("feature").agg(F.stddev_pop("value").alias("sd"))), 3)


@_query("SELECT round(exp(-sum(ll) / sum(t)), 6) AS perplexity FROM (SELECT modality, sum(value * ln(rate + 1e-8)) AS ll, sum(value) AS t FROM rt GROUP BY modality)")
def perplexity(spark, d):
    c = _numeric(spark, d)
    return rounded(L.overall_perplexity(L.multinomial(c, X.theta(spark, d), X.phi(spark, d)), c))


@_query("SELECT modality, round(exp(-sum(value * ln(rate + 1e-8)) / sum(value)), 6) AS perplexity FROM rt GROUP BY modality")
def perplexity_per_modality(spark, d):
    c = _numeric(spark, d)
    return rounded(L.perplexity(L.multinomial(c, X.theta(spark, d), X.phi(spark, d)), c))


@_query("SELECT modality, round(0.5e0 * sum(value * ln(greatest(rate, 1e-8))), 3) AS ll FROM rt GROUP BY modality")
def svem_monitor(spark, d):
    return rounded(L.svem_monitor(_numeric(spark, d), X.theta(spark, d), X.phi(spark, d), 0.5), 3)


@_query("""SELECT batch, modality, k, feature, round(e / sum(e) OVER (PARTITION BY batch, modality, k), 6) AS phi FROM (SELECT b.code AS batch, modality, k, feature, exp(ln(greatest(phi, 1e-12)) + 0.1e0 * (k + 1) * 0.05e0 * ((b.code + 1) * length(feature) % 7)) AS e
 FROM ph, (VALUES (0), (1), (2)) b(code))""")
def batch_corrected_phi(spark, d):
    phi = X.phi(spark, d)
    return rounded(L.batch_corrected_phi(phi, *_tau_delta(phi)))


_GCN = """, a1 AS (SELECT src, dst, sum(weight) AS w FROM (SELECT * FROM ed UNION ALL SELECT cell_id, cell_id, 1 FROM ce) GROUP BY ALL), dg AS (SELECT src, sum(w) AS g FROM a1 GROUP BY src),
am AS (SELECT a1.src, a1.dst, w / sqrt((d1.g + {x}) * (d2.g + {x})) AS weight FROM a1 JOIN dg d1 ON d1.src = a1.src JOIN dg d2 ON d2.src = a1.dst)
"""


@_query(_GCN.format(x="0") + "SELECT src, dst, round(weight, 6) AS weight FROM am")
def gcn_normalized_edges(spark, d):
    return rounded(G.gcn_normalised(X.edges(spark, d), X.cells(spark, d)))


@_query(_GCN.format(x="1") + """, x0 AS (SELECT x.cell_id, feature, value / greatest(lib, 1) * (SELECT quantile_disc(lib, 0.5) FROM lib WHERE modality = 'rna') AS value FROM x JOIN lib USING (cell_id, modality) WHERE modality = 'rna'),
x1 AS (SELECT am.src AS cell_id, feature, sum(weight * value) AS value FROM am JOIN x0 ON x0.cell_id = am.dst GROUP BY ALL)
SELECT cell_id, feature, 0 AS hop, round(ln(1 + value), 6) AS value FROM x0 UNION ALL SELECT cell_id, feature, 1, round(ln(1 + value), 6) FROM x1""")
def sgc_sign(spark, d):
    c = X.counts(spark, d).where("modality = 'rna'").drop("modality")
    return rounded(G.sgc(c, X.edges(spark, d), X.cells(spark, d), 1))


@_query("""SELECT cell_id, min(hop) AS hop FROM (SELECT cell_id, 0 AS hop FROM ce WHERE cell_idx % 100 = 0 UNION ALL SELECT dst, 1 FROM ed JOIN ce ON src = cell_id WHERE cell_idx % 100 = 0
 UNION ALL SELECT b.dst, 2 FROM ed a JOIN ed b ON a.dst = b.src JOIN ce ON a.src = cell_id WHERE cell_idx % 100 = 0) GROUP BY cell_id""")
def k_hop(spark, d):
    return rounded(G.k_hop(X.edges(spark, d), X.cells(spark, d).where("cell_idx % 100 = 0"), 2))


@_query(""", h1 AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat(src, ',', dst, ',0,1')), dst) AS r FROM ed JOIN ce ON src = cell_id WHERE cell_idx % 100 = 0) WHERE r <= 1),
h2 AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat(src, ',', dst, ',0,2')), dst) AS r FROM ed WHERE src IN (SELECT dst FROM h1)) WHERE r <= 2)
SELECT 1 AS hop, src, dst FROM h1 UNION ALL SELECT 2, src, dst FROM h2""")
def sampled_neighbours(spark, d):
    return rounded(G.sampled_neighbours(X.edges(spark, d), X.cells(spark, d).where("cell_idx % 100 = 0"), [1, 2]))


@_query("SELECT src, rank, dst, round(d, 5) AS distance FROM (SELECT a AS src, b AS dst, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rank FROM ds) WHERE rank <= 5")
def knn_graph(spark, d):
    return rounded(G.knn(X.embedding_cells(spark, d).select("cell_id", "point"), 5), 5)


_MORAN = """, z AS (SELECT c.cell_id, m.k, coalesce(theta, 0) - avg(coalesce(theta, 0)) OVER (PARTITION BY m.k) AS z FROM ce c CROSS JOIN (SELECT DISTINCT k FROM th) m LEFT JOIN th ON th.cell_id = c.cell_id AND th.k = m.k),
mi AS (SELECT k, (SELECT c FROM nc) / (SELECT sum(weight) FROM ed) * up / down AS i FROM (SELECT k, sum(z * z) AS down FROM z GROUP BY k) JOIN (SELECT a.k, sum(weight * a.z * b.z) AS up FROM ed JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND b.k = a.k GROUP BY a.k) USING (k))
"""


def _moran(spark, d):
    values = M.complete_theta(X.theta(spark, d)).select("cell_id", F.col("k").alias("feature"), F.col("theta").alias("value"))
    return G.morans_i(X.edges(spark, d), values)


@_query(_MORAN + "SELECT k, round(i, 6) AS i FROM mi")
def morans_i(spark, d):
    return rounded(_moran(spark, d).withColumnRenamed("feature", "k"))


@_query(_MORAN + "SELECT round(avg(i), 6) AS mean_i FROM mi")
def morans_i_mean(spark, d):
    return rounded(_moran(spark, d).agg(F.avg("i").alias("mean_i")))


@_query(None)
def mst_pseudotime(spark, d):
    """Pseudotime of all vectors: tree over their neighbours, path lengths from the smallest id, percentile ranks."""
    points = X.embedding_cells(spark, d).select("cell_id", "point")
    tree = G.spanning_tree(G.knn(points, 8).select("src", "dst", F.col("distance").alias("weight")))
    paths = G.shortest_paths(tree.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), 0)
    return rounded(E.percentile_rank(paths, "distance"))


@_query("SELECT cell_id, round(pct, 6) AS percentile FROM rk")
def percentile_rank(spark, d):
    return rounded(_ranked(spark, d).select("cell_id", F.col("pct").alias("percentile")))


@_query("SELECT round(corr(day, lib), 6) AS pearson FROM tm JOIN lib USING (cell_id) WHERE modality = 'rna'")
def pearson(spark, d):
    lib = P.library_sizes(X.counts(spark, d), X.cells(spark, d)).where("modality = 'rna'")
    return rounded(E.pearson(_times(spark, d).join(lib, "cell_id"), "day", "lib"))


@_query("SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY lib) + (count(*) OVER (PARTITION BY lib) - 1) / 2.0::DOUBLE AS rb FROM tm JOIN lib USING (cell_id) WHERE modality = 'rna')")
def spearman(spark, d):
    lib = P.library_sizes(X.counts(spark, d), X.cells(spark, d)).where("modality = 'rna'")
    return rounded(E.spearman(_times(spark, d).join(lib, "cell_id"), "day", "lib"))


_CONT = ", c AS (SELECT batch AS a, label AS b, CAST(count(*) AS DOUBLE) AS n FROM ce GROUP BY ALL), ca AS (SELECT a, sum(n) AS n FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS n FROM c GROUP BY b)\n"


@_query(_CONT + "SELECT round((sab - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS ari FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sab, (SELECT sum(n * (n - 1) / 2) FROM ca) AS sa, (SELECT sum(n * (n - 1) / 2) FROM cb) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)")
def ari(spark, d):
    return rounded(E.adjusted_rand(X.cells(spark, d), "batch", "label"))


@_query(_CONT + "SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM (SELECT (SELECT sum(c.n / t * ln(t * c.n / (ca.n * cb.n))) FROM c JOIN ca USING (a) JOIN cb USING (b)) AS mi, (SELECT -sum(n / t * ln(n / t)) FROM ca) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM cb) AS hb FROM (SELECT c AS t FROM nc))")
def nmi(spark, d):
    return rounded(E.normalized_mutual_information(X.cells(spark, d), "batch", "label"))


@_query("SELECT round(avg((o - i) / greatest(o, i)), 5) AS silhouette FROM (SELECT a, max(CASE WHEN la = lb THEN d END) AS i, min(CASE WHEN la <> lb THEN d END) AS o FROM (SELECT a, la, lb, avg(d) AS d FROM ds GROUP BY ALL) GROUP BY a)")
def silhouette(spark, d):
    return rounded(E.silhouette(X.embedding_cells(spark, d), "label"), 5)


_COSD = """, cd AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS vote, 1 - list_dot_product(a.p, b.p) / (sqrt(list_dot_product(a.p, a.p)) * sqrt(list_dot_product(b.p, b.p))) AS d FROM vv a JOIN vv b ON {on})
"""
_VV = ", vv AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS p, CAST(concat('0x', substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 = 0 AS test FROM embeddings)"


@_query(_VV + _COSD.format(on="a.test AND NOT b.test") + """, hit AS (SELECT truth, CAST(vote = truth AS DOUBLE) AS h FROM (SELECT a, vote, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, vote) AS r FROM (SELECT a, vote, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS n FROM cd) WHERE n <= 5 GROUP BY a, vote) JOIN (SELECT vec_id, label AS truth FROM embeddings) ON a = vec_id WHERE r = 1)
SELECT round((SELECT avg(h) FROM hit), 6) AS accuracy, round((SELECT avg(h) FROM (SELECT avg(h) AS h FROM hit GROUP BY truth)), 6) AS balanced_accuracy""")
def knn_accuracy(spark, d):
    return rounded(E.knn_accuracy(X.embedding_cells(spark, d), "label"))


@_query("SELECT label, a AS cell_id FROM (SELECT la AS label, a, row_number() OVER (PARTITION BY la ORDER BY round(avg(d), 9), a) AS r FROM ds WHERE la = lb GROUP BY la, a) WHERE r = 1")
def medoid(spark, d):
    return rounded(E.medoids(X.embedding_cells(spark, d), "label"))


_SIDE = """, qs AS (SELECT label, quantile_cont(pct, 0.25) AS lo, quantile_cont(pct, 0.75) AS hi FROM rk GROUP BY label HAVING count(*) >= 10), sd AS (SELECT rk.cell_id, label, pct <= lo AS early, pct >= hi AS late FROM rk JOIN qs USING (label)),
sz AS (SELECT label, sum(CAST(early AS DOUBLE)) AS ne, sum(CAST(late AS DOUBLE)) AS nl FROM sd GROUP BY label),
tc AS (SELECT label, k, sum(CASE WHEN late THEN theta ELSE 0 END) / any_value(nl) - sum(CASE WHEN early THEN theta ELSE 0 END) / any_value(ne) AS change FROM th JOIN sd USING (cell_id) JOIN sz USING (label) GROUP BY label, k),
fd AS (SELECT label, modality, feature, sum(change * phi) AS derivative FROM tc JOIN ph USING (k) GROUP BY ALL)
"""


def _change(spark, d):
    return E.topic_change(X.theta(spark, d), _ranked(spark, d), "label", "pct")


@_query(_SIDE + "SELECT label, k, round(change, 6) AS change FROM tc")
def topic_change(spark, d):
    return rounded(_change(spark, d))


@_query(_SIDE + "SELECT label, modality, feature, round(derivative, 6) AS derivative FROM fd")
def quantile_derivative(spark, d):
    return rounded(E.feature_derivatives(_change(spark, d), X.phi(spark, d), "label"))


@_query(_SIDE + """SELECT label, modality, 'up' AS direction, r AS rank, feature, round(derivative, 6) AS derivative FROM (SELECT *, row_number() OVER (PARTITION BY label, modality ORDER BY round(derivative, 9) DESC, feature) AS r FROM fd) WHERE r <= 3
 UNION ALL SELECT label, modality, 'down', r, feature, round(derivative, 6) FROM (SELECT *, row_number() OVER (PARTITION BY label, modality ORDER BY round(derivative, 9), feature) AS r FROM fd) WHERE r <= 3""")
def driver_genes(spark, d):
    return rounded(E.driver_features(E.feature_derivatives(_change(spark, d), X.phi(spark, d), "label"), "label", 3))


_BIN = ", bn AS (SELECT least(CAST(floor(pct / 0.1e0) AS BIGINT), 9) AS bin, lib FROM rk JOIN lib USING (cell_id) WHERE modality = 'rna'), bm AS (SELECT bin, avg(lib) AS mean, stddev_pop(lib) / sqrt(count(*)) AS sem, count(*) AS n FROM bn GROUP BY bin)\n"


def _binned_rows(spark, d):
    return _ranked(spark, d).join(P.library_sizes(X.counts(spark, d), X.cells(spark, d)).where("modality = 'rna'"), "cell_id")


@_query(_BIN + "SELECT bin, round(mean, 5) AS mean, round(sem, 5) AS sem, n FROM bm")
def trajectory(spark, d):
    return rounded(E.binned(_binned_rows(spark, d), "pct", "lib", 10), 5)


@_query(_BIN + "SELECT a.bin, round(a.mean - b.mean, 5) AS change FROM bm a JOIN bm b ON a.bin = b.bin + 1")
def bin_derivative(spark, d):
    return rounded(E.bin_changes(_binned_rows(spark, d), "pct", "lib", 10), 5)


@_query("SELECT label, " + ", ".join(f"round(avg(CASE WHEN k = {k} THEN theta END), 6) AS topic_{k}" for k in range(6)) + " FROM th JOIN ce USING (cell_id) GROUP BY label")
def pivot_mean(spark, d):
    t = X.theta(spark, d)
    topics = sorted(r.k for r in t.select("k").distinct().collect())
    wide = E.pivot_mean(t.join(X.cells(spark, d), "cell_id"), "label", "k", "theta", topics)
    return rounded(wide.select("label", *[F.col(str(k)).alias(f"topic_{k}") for k in topics]))


@_query("""SELECT modality, k, feature, round(sum(x.value * theta * phi / (r.rate + 1e-12)), 4) AS n FROM x JOIN (SELECT cell_id, modality, feature, rate FROM rt) r USING (cell_id, modality, feature) JOIN th USING (cell_id) JOIN ph USING (modality, k, feature) GROUP BY ALL""")
def gibbs_expected_counts(spark, d):
    _, n_gk, names = _counted(spark, d, ["protein", "rna"])
    return rounded(_by_feature(spark, names, {"n": n_gk}).where("n > 0"), 4)


@_query("""SELECT cell_id, k, round(sum(x.value * theta * phi / (r.rate + 1e-12)), 4) AS n FROM x JOIN (SELECT cell_id, modality, feature, rate FROM rt) r USING (cell_id, modality, feature) JOIN th USING (cell_id) JOIN ph USING (modality, k, feature) GROUP BY ALL""")
def gibbs_cell_counts(spark, d):
    cells, _, _ = _counted(spark, d, ["protein", "rna"])
    return rounded(cells.select("cell_id", F.posexplode("theta").alias("k", "n")).where("n > 0"), 4)


def _kernel_input(spark, d, modalities):
    """Cells with their counts of the modalities and theta in all topics, phi as features by topics, and the features' names."""
    from ..operators.inference import cell_rows

    data = B.TopicData.from_counts(X.counts(spark, d), cells=X.cells(spark, d), modalities=modalities)
    theta = M.complete_theta(X.theta(spark, d)).groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "theta"))), lambda e: e["theta"]).alias("theta"))
    names = data.features().orderBy("global_idx").toPandas()
    phi = X.phi(spark, d).where(F.col("modality").isin(modalities)).toPandas().merge(names, on=["modality", "feature"])
    matrix = np.zeros((len(names), int(phi["k"].max()) + 1))
    matrix[phi["global_idx"].to_numpy(int), phi["k"].to_numpy(int)] = phi["phi"]
    return cell_rows(data, matrix.shape[1], 1.0, 0).drop("theta").join(theta, "cell_id"), matrix, names


def _by_feature(spark, names, columns) -> DataFrame:
    """(modality, feature, k, ...) of matrices of features by topics."""
    topics = next(iter(columns.values())).shape[1]
    rows = names.loc[names.index.repeat(topics), ["modality", "feature"]].assign(k=np.tile(np.arange(topics), len(names)), **{c: np.asarray(m)[names["global_idx"].to_numpy(int)].ravel() for c, m in columns.items()})
    return spark.createDataFrame(rows, "modality string, feature string, k long, " + ", ".join(f"{c} double" for c in columns))


def _counted(spark, d, modalities):
    from ..operators import kernels as K
    from ..operators.inference import sweep

    cells, phi, names = _kernel_input(spark, d, modalities)

    def kernel(batch, x):
        n_ck, p = K.expected_entries(x, batch["theta"], phi)
        return n_ck, [(x.idx, p)]

    return *sweep(cells, kernel, phi.shape), names


def _estep(spark, d, modality, step):
    """(kind, id, k, value): responsibilities of cells, and weighted counts of features; step(x, log theta, phi) is the kernel."""
    from ..operators.inference import sweep

    cells, phi, names = _kernel_input(spark, d, [modality])
    n_ck, m_gk = sweep(cells, lambda batch, x: step(x, np.log(np.stack(batch["theta"]) + 0.01), phi), phi.shape)
    of_cells = n_ck.select(F.lit("cell").alias("kind"), F.col("cell_id").cast("string").alias("id"), F.posexplode("theta").alias("k", "value"))
    return rounded(of_cells.unionByName(_by_feature(spark, names, {"value": m_gk}).select(F.lit("feature").alias("kind"), F.col("feature").alias("id"), F.col("k").cast("int").alias("k"), "value")), 4)


_ESTEP = """, de AS (SELECT c.cell_id, f.feature, kk.k, coalesce(x.value, 0) AS v, ln(coalesce(theta, 0) + 0.01e0) AS lt, coalesce(phi, 0) AS p FROM ce c CROSS JOIN (SELECT DISTINCT feature FROM x WHERE modality = '{m}') f CROSS JOIN kk
 LEFT JOIN x ON x.cell_id = c.cell_id AND x.modality = '{m}' AND x.feature = f.feature LEFT JOIN th ON th.cell_id = c.cell_id AND th.k = kk.k LEFT JOIN ph ON ph.modality = '{m}' AND ph.feature = f.feature AND ph.k = kk.k),
lw AS (SELECT cell_id, feature, k, v, {w} AS w FROM de), ex AS (SELECT cell_id, feature, k, v, exp(w - max(w) OVER (PARTITION BY cell_id, feature)) AS e FROM lw), rho AS (SELECT cell_id, feature, k, v, e / sum(e) OVER (PARTITION BY cell_id, feature) AS r FROM ex)
SELECT 'cell' AS kind, CAST(cell_id AS VARCHAR) AS id, k, round(sum(r), 4) AS value FROM rho GROUP BY cell_id, k UNION ALL SELECT 'feature', feature, k, round(sum(r * v), 4) FROM rho GROUP BY feature, k"""


@_query(_ESTEP.format(m="rna", w="lt + v * ln(p + 0.01e0) - 3 * p"))
def svem_estep_poisson(spark, d):
    from ..operators import kernels as K

    return _estep(spark, d, "rna", lambda x, log_theta, phi: K.svem_estep_poisson(x, log_theta, np.log(phi + 0.01), 3 * phi))


@_query(_ESTEP.format(m="protein", w="lt + v * ln(greatest((10 * p + 0.1e0) / sum(10 * p + 0.1e0) OVER (PARTITION BY cell_id, k), 1e-32))"))
def svem_estep_dirichlet(spark, d):
    from ..operators import kernels as K

    return _estep(spark, d, "protein", lambda x, log_theta, phi: K.svem_estep_dirichlet(x, log_theta, 10 * phi + 0.1))


@_query("""SELECT s.modality, s.feature, kk.k, round((1 - rho) * (0.1e0 + s / sum(s) OVER (PARTITION BY s.modality, kk.k)) + rho * (coalesce(n, 0) + 0.1e0), 5) AS a, round((1 - rho) + rho * (mass + 0.1e0), 5) AS b
 FROM (SELECT modality, feature, sum(value) AS s FROM x GROUP BY ALL) s CROSS JOIN kk JOIN (SELECT k, sum(theta) AS mass FROM th GROUP BY k) USING (k) JOIN (SELECT modality, pow(1024 + row_number() OVER (ORDER BY modality), -0.6e0) AS rho FROM (SELECT DISTINCT modality FROM x)) USING (modality)
 LEFT JOIN (SELECT modality, k, feature, sum(theta * value) AS n FROM x JOIN th USING (cell_id) GROUP BY ALL) t ON t.modality = s.modality AND t.feature = s.feature AND t.k = kk.k""")
def svem_mstep(spark, d):
    """Every modality's A and B after its step, from 0.1 + share and 1, and with theta' X as what the cells say."""
    from ..operators import kernels as K

    data = B.TopicData.from_counts(X.counts(spark, d), cells=X.cells(spark, d))
    names = data.features().orderBy("global_idx").toPandas()
    said = M.topic_feature_counts(data.counts, X.theta(spark, d)).toPandas().merge(names, on=["modality", "feature"])
    mass = X.theta(spark, d).groupBy("k").agg(F.sum("theta").alias("n")).orderBy("k").toPandas()["n"].to_numpy()
    m = np.zeros((len(names), len(mass)))
    m[said["global_idx"].to_numpy(int), said["k"].to_numpy(int)] = said["n"]
    share = P.dirichlet_prior(data.counts, floor=0.1).toPandas().merge(names, on=["modality", "feature"])
    a, b = np.zeros_like(m), np.ones_like(m)
    a[share["global_idx"].to_numpy(int)] = share["beta"].to_numpy()[:, None]
    for step, modality in enumerate(data.modalities, 1):
        at = names.loc[names["modality"] == modality, "global_idx"].to_numpy(int)
        a[at], b[at] = K.svem_mstep(a[at], b[at], m[at], mass, K.svem_rate(step))
    return rounded(_by_feature(spark, names, {"a": a, "b": b}), 5)


@_query("""SELECT modality, feature, kk.k, round(g + coalesce(n, 0), 4) AS shape, round(t + mass, 5) AS rate FROM (SELECT DISTINCT modality, feature FROM x WHERE modality = 'rna') f CROSS JOIN kk JOIN (SELECT k, sum(theta) AS mass FROM th GROUP BY k) USING (k)
 JOIN (SELECT modality, m * m / v AS g, m / v AS t FROM (SELECT modality, s / n AS m, greatest(q / n - (s / n) * (s / n), 1e-6) AS v FROM (SELECT modality, sum(value) AS s, sum(value * value) AS q, count(DISTINCT feature) * (SELECT c FROM nc) AS n FROM x GROUP BY modality))) USING (modality)
 LEFT JOIN (SELECT modality, k, feature, sum(x.value * theta * phi / (r.rate + 1e-12)) AS n FROM x JOIN (SELECT cell_id, modality, feature, rate FROM rt) r USING (cell_id, modality, feature) JOIN th USING (cell_id) JOIN ph USING (modality, k, feature) GROUP BY ALL) e USING (modality, k, feature)""")
def gibbs_posterior_params(spark, d):
    from ..operators import kernels as K

    _, n_gk, names = _counted(spark, d, ["rna"])
    mass = X.theta(spark, d).groupBy("k").agg(F.sum("theta").alias("n")).orderBy("k").toPandas()["n"].to_numpy()
    prior = P.scalar_prior(X.counts(spark, d).where("modality = 'rna'"), _n(spark, d)).head()
    shape, rate = K.posterior_gamma(n_gk, mass, prior.gamma, prior.tau)
    frame = _by_feature(spark, names, {"shape": shape, "rate": rate})
    return frame.select("modality", "feature", "k", F.round("shape", 4).alias("shape"), F.round("rate", 5).alias("rate"))


@_query("""SELECT cell_id, feature, min(k) AS k FROM (SELECT x.cell_id, x.feature, th.k, sum(theta * coalesce(phi, 0)) OVER (PARTITION BY x.cell_id, x.feature ORDER BY th.k) AS c, sum(theta * coalesce(phi, 0)) OVER (PARTITION BY x.cell_id, x.feature) AS t, ((x.cell_id * 7919 + g * 104729) % 1000) / 1000e0 + 0.0005e0 AS u
 FROM x JOIN (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS g FROM (SELECT DISTINCT feature FROM x WHERE modality = 'protein')) USING (feature) JOIN th USING (cell_id) LEFT JOIN ph ON ph.modality = x.modality AND ph.k = th.k AND ph.feature = x.feature WHERE x.modality = 'protein') WHERE c >= u * t GROUP BY cell_id, feature""")
def inverse_cdf_topic(spark, d):
    """A topic for each non-zero of protein, drawn with numbers that follow from cell and feature."""
    import pandas as pd

    from ..operators import kernels as K
    from ..operators.inference import sparse

    cells, phi, names = _kernel_input(spark, d, ["protein"])
    features = names.sort_values("global_idx")["feature"].to_numpy()

    def run(batches):
        for batch in batches:
            x, ids = sparse(batch), batch["cell_id"].to_numpy(np.int64)
            u = (ids[x.row] * 7919 + x.idx * 104729) % 1000 / 1000 + 0.0005
            yield pd.DataFrame({"cell_id": ids[x.row], "feature": features[x.idx], "k": K.inverse_cdf(K.at_non_zeros(x, np.stack(batch["theta"]), phi), u)})

    return cells.mapInPandas(run, "cell_id long, feature string, k long")


@_query("""SELECT run, it, round(CASE WHEN it >= 50 THEN abs(new - old) / (abs(old) + 1e-12) END, 6) AS change, streak, max(CAST(streak >= 3 AS BIGINT)) OVER (PARTITION BY run ORDER BY it) AS converged FROM (SELECT *, CASE WHEN small THEN row_number() OVER (PARTITION BY run, g ORDER BY it) - CASE WHEN g = 0 THEN 0 ELSE 1 END ELSE 0 END AS streak FROM
 (SELECT *, sum(CAST(NOT small AS BIGINT)) OVER (PARTITION BY run ORDER BY it) AS g FROM (SELECT *, coalesce(it >= 50 AND abs(new - old) / (abs(old) + 1e-12) < 1e-2, false) AS small FROM (SELECT run, it, avg(ll) OVER (PARTITION BY run ORDER BY it ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS new, avg(ll) OVER (PARTITION BY run ORDER BY it ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) AS old
 FROM (SELECT l_suppkey % 50 AS run, it, -1000 - 900e0 / it - l_quantity AS ll FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_orderkey, l_linenumber, l_quantity) AS it FROM lineitem))))))""", fx=False)
def burnin_monitor(spark, d):
    """What the burn-in monitor says after each value of fifty histories."""
    from pyspark.sql.window import Window

    lines = X.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("run"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    rows = lines.withColumn("it", F.row_number().over(Window.partitionBy("run").orderBy("l_orderkey", "l_linenumber", "q")))
    got = S.burnin_windows(rows.select("run", "it", (-1000 - 900 / F.col("it") - F.col("q")).alias("ll")), "run", "it", "ll", rtol=1e-2)
    return rounded(got.withColumn("converged", F.col("converged").cast("int")))


@_query("""SELECT cell_id, modality, round(e / sum(e) OVER (PARTITION BY cell_id), 6) AS weight FROM (SELECT cell_id, modality, CASE WHEN modality = 'protein' AND cell_id % 7 = 0 THEN 0 ELSE exp(0.7e0 * tanh(0.5e0 * a + 0.2e0 * b) - 0.4e0 * tanh(-0.3e0 * a + 0.9e0 * b)) END AS e
 FROM (SELECT cell_id, modality, ln(1 + lib) / 10 AS a, CAST(length(modality) AS DOUBLE) / 10 AS b FROM lib))""")
def attention_weights(spark, d):
    lib = P.library_sizes(X.counts(spark, d), X.cells(spark, d))
    there = (~((F.col("modality") == "protein") & (F.col("cell_id") % 7 == 0))).cast("int")
    rows = lib.select("cell_id", "modality", F.array(F.log1p("lib") / 10, F.length("modality") / 10.0).alias("mu"), there.alias("present"))
    return rounded(M.attention_weights(rows, [[0.5, -0.3], [0.2, 0.9]], [0.7, -0.4]))


def _tau_delta(phi):
    tau = phi.select("k").distinct().select("k", (0.1 * (F.col("k") + 1)).alias("tau"))
    batches = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    return tau, phi.select("feature").distinct().select("feature", batches.alias("batch")).select("batch", "feature", (0.05 * ((F.col("batch") + 1) * F.length("feature") % 7)).alias("delta"))


@_query("""SELECT modality, round(sum(value * ln(rate + 1e-8)), 3) AS ll FROM (SELECT x.cell_id, x.modality, x.feature, x.value, sum(theta * coalesce(p.phi, 0)) AS rate FROM x JOIN th USING (cell_id) LEFT JOIN
 (SELECT batch, modality, k, feature, e / sum(e) OVER (PARTITION BY batch, modality, k) AS phi FROM (SELECT b.code AS batch, modality, k, feature, exp(ln(greatest(phi, 1e-12)) + 0.1e0 * (k + 1) * 0.05e0 * ((b.code + 1) * length(feature) % 7)) AS e FROM ph, (VALUES (0), (1), (2)) b(code))) p
 ON p.batch = x.cell_id % 3 AND p.modality = x.modality AND p.k = th.k AND p.feature = x.feature WHERE x.modality <> 'chromatin' GROUP BY ALL) GROUP BY modality""")
def batch_corrected_ll(spark, d):
    phi = X.phi(spark, d)
    batches = X.cells(spark, d).select("cell_id", (F.col("cell_id") % 3).alias("batch"))
    return rounded(L.batch_corrected_multinomial(_numeric(spark, d), X.theta(spark, d), L.batch_corrected_phi(phi, *_tau_delta(phi)), batches), 3)


@_query("SELECT b.code AS batch, modality, k, feature, round(10 * phi + 0.1e0 * (k + 1) * 0.05e0 * ((b.code + 1) * length(feature) % 7), 6) AS mean FROM ph, (VALUES (0), (1), (2)) b(code)")
def batch_corrected_means(spark, d):
    phi = X.phi(spark, d)
    return rounded(L.batch_corrected_means(phi.withColumn("mean", 10 * F.col("phi")), *_tau_delta(phi)))


@_query(""", bg AS (SELECT modality, feature, ln(sum(value / lib) / (SELECT c FROM nc) + 1e-15) AS b FROM x JOIN lib USING (cell_id, modality) GROUP BY ALL), pb AS (SELECT modality, k, feature, e / sum(e) OVER (PARTITION BY modality, k) AS phi FROM (SELECT modality, k, feature, exp(ln(greatest(phi, 1e-12)) + b) AS e FROM ph JOIN bg USING (modality, feature))),
gb AS (SELECT g.cell_id, g.modality, g.rate, coalesce(x.value, 0) AS value FROM (SELECT cell_id, modality, feature, sum(theta * phi) AS rate FROM th JOIN pb USING (k) GROUP BY ALL) g LEFT JOIN x ON x.cell_id = g.cell_id AND x.modality = g.modality AND x.feature = g.feature),
nb AS (SELECT gb.modality, value, 1e0 AS r, greatest(rate * lib, 1e-8) AS mu FROM gb JOIN lib USING (cell_id, modality))
SELECT modality, round(sum(lgamma(value + r) - lgamma(r) - lgamma(value + 1) + r * ln(r / (r + mu)) + value * ln(mu / (r + mu))), 3) AS ll FROM nb GROUP BY modality""")
def ll_background(spark, d):
    c = _numeric(spark, d)
    return rounded(L.negative_binomial(c, X.theta(spark, d), L.with_background(X.phi(spark, d), P.feature_background(c, _n(spark, d)))), 3)


@_query("SELECT label, round(avg(lib), 6) AS mean, round(stddev_pop(lib), 5) AS sd, count(*) AS n FROM ce JOIN lib USING (cell_id) WHERE modality = 'rna' GROUP BY label")
def runs_mean_std(spark, d):
    lib = P.library_sizes(X.counts(spark, d), X.cells(spark, d)).where("modality = 'rna'")
    got = S.over_runs(X.cells(spark, d).join(lib, "cell_id"), "label", "lib")
    return got.select(F.col("label").cast("long").alias("label"), F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"), "n")


@_query("SELECT modality, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS sd FROM (SELECT cell_id, modality, z / sum(z) OVER (PARTITION BY cell_id) AS weight FROM (SELECT cell_id, modality, CASE WHEN modality = 'protein' AND cell_id % 7 = 0 THEN 0 WHEN modality = 'rna' THEN exp(1e0) WHEN modality = 'protein' THEN exp(0.5e0) ELSE 1 END AS z FROM lib)) GROUP BY modality")
def modality_weight_stats(spark, d):
    c = X.counts(spark, d).where("not (modality = 'protein' and cell_id % 7 = 0)")
    return rounded(S.weight_stats(M.modality_weights(P.presence(c, X.cells(spark, d)), "cell", {"rna": 1.0, "protein": 0.5, "chromatin": 0.0})))


@_query("SELECT CAST(least(floor((lib - lo) * 20 / (hi - lo)), 19) AS BIGINT) AS bin, count(*) AS n FROM lib, (SELECT min(lib) AS lo, max(lib) AS hi FROM lib WHERE modality = 'rna') WHERE modality = 'rna' GROUP BY 1")
def histogram(spark, d):
    return S.histogram(P.library_sizes(X.counts(spark, d), X.cells(spark, d)).where("modality = 'rna'"), "lib", 20)


@_query(_SIDE + "SELECT feature, round(size, 6) AS size FROM (SELECT feature, max(abs(derivative)) AS size FROM fd GROUP BY feature) ORDER BY round(size, 9) DESC, feature LIMIT 10")
def top_by_max_abs(spark, d):
    return rounded(S.top_by_max_abs(E.feature_derivatives(_change(spark, d), X.phi(spark, d), "label"), "feature", "derivative", 10))


@_query("SELECT k, label, round(mean, 6) AS mean FROM (SELECT k, label, mean, row_number() OVER (PARTITION BY k ORDER BY round(mean, 9) DESC, label) AS r FROM (SELECT label, k, sum(theta) / any_value(n) AS mean FROM th JOIN ce USING (cell_id) JOIN (SELECT label, count(*) AS n FROM ce GROUP BY label) USING (label) GROUP BY label, k)) WHERE r = 1")
def best_label(spark, d):
    return rounded(S.best_of(M.theta_by_group(X.theta(spark, d), X.cells(spark, d), "label"), "k", "label", "mean"))


@_query("SELECT modality, feature, place FROM (SELECT modality, feature, row_number() OVER (PARTITION BY modality ORDER BY CASE WHEN r <= 3 THEN r END NULLS LAST, round(var, 6) DESC, feature) AS place FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY round(var, 6) DESC, feature) AS r FROM mom)) WHERE place <= 6")
def hvg_rank_prefix(spark, d):
    """The first three by rank, the rest by their norm, which is the variance here."""
    ranked = P.top_variance_features(X.counts(spark, d), _n(spark, d), 1 << 30)
    ranked = ranked.select("modality", "feature", F.when(F.col("rank") <= 3, F.col("rank")).alias("rank"), F.round("var", 6).alias("norm"))
    return rounded(S.hvg_prefix(ranked, 6).select("modality", "feature", "place"))


_RUN = "concat(p_brand, CASE p_size % 4 WHEN 0 THEN '_gcn' || (p_size % 3 + 1) WHEN 1 THEN '_gat' ELSE '' END, CASE p_size % 3 WHEN 0 THEN '_universal' WHEN 1 THEN '_cell' ELSE '' END)"


@_query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'gcn' WHEN 1 THEN 'gat' ELSE 'mlp' END AS encoder, CASE WHEN p_size % 4 = 0 THEN p_size % 3 + 1 END AS layers, CASE p_size % 3 WHEN 0 THEN 'universal' WHEN 1 THEN 'cell' ELSE 'equal' END AS weighting FROM part", fx=False)
def parse_run_config(spark, d):
    return rounded(S.parse_run(X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_RUN).alias("run")), "run").drop("run"))


@_query("SELECT label AS method, round(avg(lib), 6) AS depth, count(DISTINCT cell_id) AS cells FROM ce JOIN lib USING (cell_id) WHERE modality = 'rna' GROUP BY label")
def metrics_merge(spark, d):
    cells = X.cells(spark, d).withColumnRenamed("label", "method")
    lib = P.library_sizes(X.counts(spark, d), X.cells(spark, d)).where("modality = 'rna'")
    depth = cells.join(lib, "cell_id").groupBy("method").agg(F.avg("lib").alias("depth"))
    return rounded(S.merge_metrics(depth, cells.groupBy("method").agg(F.count("*").alias("cells"))))


@_query(_COS + """SELECT 'mean_entropy' AS metric, round((SELECT avg(e) FROM (SELECT -sum(t * ln(greatest(t, 1e-8))) AS e FROM (SELECT cell_id, theta / (sum(theta) OVER (PARTITION BY cell_id) + 1e-12) AS t FROM th) GROUP BY cell_id)), 6) AS value
 UNION ALL SELECT 'diversity', round((SELECT avg(v) FROM (SELECT 1 - avg(cosine) AS v FROM co GROUP BY modality)), 6) UNION ALL SELECT 'perplexity', round((SELECT exp(-sum(ll) / sum(t)) FROM (SELECT modality, sum(value * ln(rate + 1e-8)) AS ll, sum(value) AS t FROM rt GROUP BY modality)), 6)""")
def summary_table(spark, d):
    c, theta, phi = _numeric(spark, d), X.theta(spark, d), X.phi(spark, d)
    return rounded(S.summary_table({"mean_entropy": M.mean_entropy(theta), "diversity": M.mean_topic_diversity(phi), "perplexity": L.overall_perplexity(L.multinomial(c, theta, phi), c)}))


@_query("SELECT src AS row, dst AS col, weight FROM ed")
def coo_edges(spark, d):
    return rounded(G.coo(X.edges(spark, d).groupBy(F.col("src").alias("cell_id")).agg(F.collect_list(F.struct("dst", "weight")).alias("neighbours"))))


@_query("SELECT modality, feature, round(exp(ln(1 + mean) + 0.02e0), 6) AS dispersion FROM mom")
def learned_dispersion(spark, d):
    rows = P.feature_moments(X.counts(spark, d), _n(spark, d)).select("modality", "feature", F.log1p("mean").alias("mu"), F.lit(0.2).alias("sigma"))
    return rounded(M.learned_dispersion(rows).select("modality", "feature", "dispersion"))


@_query("SELECT cell_id, label FROM ce ORDER BY cell_id LIMIT 50")
def max_items(spark, d):
    return rounded(S.capped(X.cells(spark, d).select("cell_id", "label"), 50, "cell_id"))


@_query("""SELECT p_partkey AS id, round((lgamma(x + 1e-4) - lgamma(x - 1e-4)) / 2e-4, 4) AS digamma, round(ln(1 + exp(x - 20)), 6) AS softplus, round(greatest(least((x - 20) * 1e4, 1e5), -1e5), 6) AS symmetric, round(greatest(least((x - 20) * 1e4, 1e5), 1e-5), 6) AS positive
 FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.25e0 AS x FROM part)""", fx=False)
def special_functions(spark, d):
    from ..functions import special

    x = F.col("x")
    rows = X.table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("double") + 0.25).alias("x"))
    got = rows.select(F.col("p_partkey").alias("id"), F.round(special.digamma(x), 4).alias("digamma"), F.round(special.softplus(x - 20), 6).alias("softplus"), F.round(special.clamp_symmetric((x - 20) * 1e4), 6).alias("symmetric"), F.round(special.clamp_positive((x - 20) * 1e4), 6).alias("positive"))
    return rounded(got)


@_query(_SIDE + "SELECT label, round(avg(CASE WHEN early THEN lib END), 5) AS early, round(avg(CASE WHEN late THEN lib END), 5) AS late FROM sd JOIN lib USING (cell_id) WHERE modality = 'rna' GROUP BY label")
def quantile_means(spark, d):
    return rounded(E.quantile_means(_binned_rows(spark, d), "label", "pct", "lib"), 5)


@_query("SELECT cell_id, modality, feature, round_even(least(greatest(value / 4 - 1, 0), 1), 0) AS value FROM x WHERE cell_id IN (SELECT cell_id FROM ce WHERE label < 5)")
def select_cells_binary(spark, d):
    data = B.TopicData.from_counts(X.counts(spark, d).withColumn("value", F.col("value") / 4 - 1), cells=X.cells(spark, d))
    kept = P.select_cells(data.counts, X.cells(spark, d).where("label < 5"))
    return P.clamp_round(kept, binary=True).select("cell_id", "modality", "feature", "value")


@_query("SELECT a AS src, rank, b AS dst, round(d, 5) AS distance FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rank FROM cd) WHERE rank <= 5".join((_VV + _COSD.format(on="a.vec_id <> b.vec_id"), "")))
def knn_cosine(spark, d):
    return rounded(G.knn(X.embedding_cells(spark, d).select("cell_id", "point"), 5, "cosine"), 5)


@_query("""SELECT id, round(tan(u * pi() / 2), 5) AS half_cauchy, round(pow(sin(u * pi() / 2), 2), 6) AS beta, round(z, 6) AS normal, round(1 / greatest(z * z, 0.0001e0), 4) AS inverse_gamma, round(0.01e0 * z / sqrt(-ln(u)), 6) AS student
 FROM (SELECT id, u, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM (SELECT p_partkey AS id, (p_partkey % 97 + 0.5e0) / 97 AS u, (p_partkey % 89 + 0.25e0) / 89 AS v FROM part))""", fx=False)
def prior_transforms(spark, d):
    """What the priors make of given uniform numbers."""
    rows = X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 97 + 0.5) / 97).alias("u"), ((F.col("p_partkey") % 89 + 0.25) / 89).alias("v"))
    u, z = F.col("u"), PR.normal(F.col("u"), F.col("v"))
    got = rows.select("id", F.round(PR.half_cauchy(u), 5).alias("half_cauchy"), PR.beta_half(u).alias("beta"), z.alias("normal"), F.round(F.least(PR.inverse_gamma_half(u, F.col("v")), F.lit(10000.0)), 4).alias("inverse_gamma"), PR.student_t10(z, [u] * 5, 0.01).alias("student"))
    return rounded(got)


@_query("SELECT i - 1 AS i, j - 1 AS j, round(covar_samp(CAST(point[i] AS DOUBLE), CAST(point[j] AS DOUBLE)), 5) + 0e0 AS cov FROM em, (SELECT unnest(range(1, (SELECT max(len(point)) + 1 FROM em))) AS i) a, (SELECT unnest(range(1, (SELECT max(len(point)) + 1 FROM em))) AS j) b GROUP BY ALL")
def pca_covariance(spark, d):
    got = rounded(FA.covariance(X.embedding_cells(spark, d).select("cell_id", "point")), 5)
    return got.withColumn("cov", F.col("cov") + 0.0)  # no negative zeros


@_query("""SELECT cell_id, modality, feature, round(ln(1 + 1e4 * v / sum(v) OVER (PARTITION BY cell_id, modality)), 5) AS value
 FROM (SELECT cell_id, modality, feature, value * (SELECT c FROM nc) / sum(value) OVER (PARTITION BY modality, feature) AS v FROM x)""")
def tf_idf(spark, d):
    return rounded(FA.tf_idf(X.counts(spark, d), _n(spark, d)).select("cell_id", "modality", "feature", "value"), 5)


@_query("""SELECT round(avg(f), 6) AS f1_macro, round(sum(f * n) / sum(n), 6) AS f1_weighted FROM (
 SELECT k, 2e0 * (SELECT count(*) FROM ce WHERE label % 5 = k AND cell_id % 5 = k) / ((SELECT count(*) FROM ce WHERE label % 5 = k) + (SELECT count(*) FROM ce WHERE cell_id % 5 = k)) AS f, (SELECT count(*) FROM ce WHERE label % 5 = k) AS n
 FROM (SELECT label % 5 AS k FROM ce UNION SELECT cell_id % 5 FROM ce))""")
def f1_scores(spark, d):
    return rounded(E.f1_scores(X.cells(spark, d).selectExpr("label % 5 AS label", "cell_id % 5 AS said"), "label", "said"))


@_query(None)
def pca(spark, d):
    return rounded(FA.pca(X.embedding_cells(spark, d).select("cell_id", "point"), 10).select("cell_id", F.posexplode("scores").alias("component", "score")), 5)


@_query(None)
def lsi(spark, d):
    data = X.bundle(spark, d)
    return rounded(FA.lsi(data.counts, data.features(), data.cells.count(), 10).select("cell_id", F.posexplode("scores").alias("component", "score")), 5)


@_query(None)
def forest_scores(spark, d):
    return rounded(E.forest_scores(X.embedding_cells(spark, d), "label"))


@_query(None)
def communities(spark, d):
    """Label propagation over the neighbour graph of all vectors."""
    near = G.knn(X.embedding_cells(spark, d).select("cell_id", "point"), 8).select("src", "dst", (1 / (1 + F.col("distance"))).alias("weight"))
    return rounded(G.label_propagation(near))


@_query(None)
def svem_fit(spark, d):
    from ..operators.inference import fit_svem

    return rounded(fit_svem(X.bundle(spark, d), n_topics=4).theta())


@_query(None)
def gibbs_fit(spark, d):
    from ..operators.inference import fit_gibbs

    return rounded(fit_gibbs(X.bundle(spark, d), n_topics=4).theta())


@_query(None)
def sharetopic_fit(spark, d):
    from ..operators.inference import fit_sharetopic

    return rounded(fit_sharetopic(X.bundle(spark, d), n_topics=4).theta())


@_query(None)
def variational_fit(spark, d):
    from ..operators.inference import fit_variational

    return rounded(fit_variational(X.bundle(spark, d), n_topics=4).theta())


@_query(None)
def generate_cells(spark, d):
    from ..operators.inference import fit_gibbs

    return rounded(fit_gibbs(X.bundle(spark, d), n_topics=4).generate(200))


def queries() -> dict:
    from . import encoders, wide  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import encoders, wide  # noqa: F401

    return dict(_SQL)
