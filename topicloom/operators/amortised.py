"""The amortised multimodal topic model: encoders give each cell's topics, and a bound of the likelihood trains everything.

A cell's topics are softmax of a normal vector. Each modality's encoder gives its mean and variance from the cell's
log-normalised values (and covariate level); those of the modalities that the cell has are mixed as Gaussians, by equal,
global, per-cell or attention weights. Topics' features are softmax (for continuous values: plain) of normal logits, or of
a horseshoe's, plus a background of counts; covariate levels shift the logits. Bound: log likelihoods of the modalities, less
the divergences of all posteriors from their priors (closed for normals, at the draw for the rest), plus bonuses
for the entropy of cells' topics and for topics' variance over cells.

One step is one set of draws. Those of topics and features are made on the driver, which knows only parameters; those of
cells follow from seed, step and cell_id, so that a lost task draws the same again. A task goes through its cells in
blocks, adds up the gradients of encoders and of the drawn logits, and Spark adds those of all tasks; the driver passes
them on to the posteriors' parameters and takes a step of Adam with decoupled decay. Means over all cells of the step,
which the variance bonus and batch normalisation need, come from passes before it. Cells are
written once, in as many sets of `parts` as an epoch has steps, so that a step reads its own cells only and writes their weights
alone; a block holds BLOCK values at most, and touches the encoder's rows of the features that its cells have.
Zeros add nothing to a multinomial likelihood or to what an encoder reads of counts, so that a step over such a modality goes
through non-zeros only; the others are dense within a block.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gradients as A
from ..functions.gradients import Rows, Var
from ..functions.lineage import checkpointed
from ..sources.bundle import TopicData, one_covariate
from . import kernels as K
from .inference import TopicModel, generator, sparse
from .metrics import logistic_normal
from .parts import Parts, entries_of

#: Values of cells by features that a task holds at a time, and of a gradient in one row.
BLOCK, PIECE = 1 << 20, 1 << 14
# Bounds of variances and of logarithms, and the scale at which posteriors start.
LEAST_VAR, MOST, VAR_EPS, LOG_EPS, START = 1e-5, 1e5, 1e-4, 1e-8, 0.1
_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)
LIKELIHOODS = ("multinomial", "gamma_poisson", "nb", "bernoulli", "gaussian")


@dataclass(frozen=True)
class Spec:
    """What is fitted. sizes: features of each modality; levels: of the categorical covariate, 0 without."""

    modalities: tuple[str, ...]
    sizes: tuple[int, ...]
    likelihoods: tuple[str, ...]
    n_topics: int = 20
    n_hidden: int = 128
    cell_prior: float | tuple[float, ...] | None = None
    feature_prior: float | None = None
    prior_type: str = "logistic_normal"
    background: bool = True
    learnable_bg: bool = True
    dispersion: float = 1.0
    learnable_dispersion: bool = False
    global_dispersion: bool = True
    weight_mode: str = "cell"
    likelihood_weight_mode: str = "none"
    likelihood_weight_ref: str = "mean"
    normalize_inputs: bool = True
    entropy_weight: float = 0.01
    topic_variance_weight: float = 1.0
    kl_weight: float = 1.0
    levels: int = 0
    encode_covariates: bool = True
    aggregation: str = "moe"
    att_dim: int = 32
    encoder: str = "mlp"
    hops: int = 1

    def __post_init__(self):
        choices = {"prior_type": ("logistic_normal", "horseshoe"), "weight_mode": ("equal", "universal", "cell"), "likelihood_weight_mode": ("none", "inverse_features", "sqrt_inverse_features"), "likelihood_weight_ref": ("mean", "median", "max"), "aggregation": ("moe", "attention"), "encoder": ("mlp", "sgc")}
        for name, known in choices.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}, not {getattr(self, name)!r}")
        if not len(self.modalities) == len(self.sizes) == len(self.likelihoods):
            raise ValueError("modalities, sizes and likelihoods must be of one length")
        if bad := [x for x in self.likelihoods if x not in LIKELIHOODS]:
            raise ValueError(f"unknown likelihoods {bad}; known: {LIKELIHOODS}")
        if self.n_topics < 1 or self.n_hidden < 1:
            raise ValueError("topics and hidden units must be at least 1")
        if isinstance(self.cell_prior, tuple) and len(self.cell_prior) not in (1, self.n_topics):
            raise ValueError(f"the cells' prior has {len(self.cell_prior)} values for {self.n_topics} topics")

    @property
    def has_bg(self) -> list[bool]:
        return [self.background and kind in ("gamma_poisson", "nb") for kind in self.likelihoods]

    @property
    def weights(self) -> np.ndarray:
        """Of the modalities' likelihoods."""
        n = np.array(self.sizes, dtype=np.float64)
        if self.likelihood_weight_mode == "none":
            return np.ones(len(n))
        share = {"mean": n.mean(), "median": np.sort(n)[(len(n) - 1) // 2], "max": n.max()}[self.likelihood_weight_ref] / n
        return np.sqrt(share) if self.likelihood_weight_mode.startswith("sqrt") else share

    @property
    def theta_prior(self) -> tuple[np.ndarray, np.ndarray]:
        a = 1.0 / self.n_topics if self.cell_prior is None else self.cell_prior
        mean, sd = logistic_normal(list(np.broadcast_to(np.asarray(a, dtype=np.float64), (self.n_topics,))))
        return np.array(mean), np.array(sd)

    def phi_prior_sd(self, size: int) -> float:
        """Of the logits under the logistic normal that stands for a symmetric Dirichlet; their mean is 0. Not 0 for one feature."""
        a = 1.0 / self.n_topics if self.feature_prior is None else self.feature_prior
        return float(np.sqrt(max((1 - 1 / size) / a, LEAST_VAR)))


Params = dict[str, np.ndarray]


def start(spec: Spec, seed: int = 0) -> tuple[Params, Params]:
    """First values of the encoders' parameters, and of those of the posteriors over topics and features."""
    rng, k, h = generator(seed, 0, 11), spec.n_topics, spec.n_hidden
    raw = np.log(np.expm1(START))
    enc, glo = {}, {}
    for m, n in enumerate(spec.sizes):
        n_in = n * (spec.hops + 1 if spec.encoder == "sgc" else 1)
        enc |= {f"w1_{m}": rng.normal(0, np.sqrt(2 / (n_in + h)), (n_in, h)), f"b1_{m}": np.zeros(h), f"w2_{m}": rng.normal(0, np.sqrt(2 / (h + k)), (h, k)), f"b2_{m}": np.zeros(k), f"w3_{m}": rng.normal(0, np.sqrt(2 / (h + k)), (h, k)), f"b3_{m}": np.zeros(k)}
        if spec.levels and spec.encode_covariates and spec.encoder == "mlp":
            enc[f"c1_{m}"] = rng.normal(0, np.sqrt(2 / (spec.levels + h)), (spec.levels, h))
        if spec.encoder == "sgc":
            enc[f"shift_{m}"] = np.zeros((max(spec.levels, 1), k))
        at = lambda *shape: np.full(shape, raw)
        glo |= {f"beta_loc_{m}": rng.normal(0, 0.5, (k, n)), f"beta_raw_{m}": at(k, n)}
        if spec.prior_type == "horseshoe":
            for name, shape in (("caux", (1, 1)), ("tau", (k, 1)), ("delta", (1, n)), ("lam", (k, n))):
                glo |= {f"{name}_loc_{m}": np.zeros(shape), f"{name}_raw_{m}": at(*shape)}
        if spec.has_bg[m] and spec.learnable_bg:
            glo |= {f"bg_loc_{m}": np.zeros((1, n)), f"bg_raw_{m}": at(1, n)}
        if spec.learnable_dispersion and spec.likelihoods[m] in ("gamma_poisson", "nb"):
            glo |= {f"disp_loc_{m}": np.zeros((1, 1 if spec.global_dispersion else n)), f"disp_raw_{m}": at(1, 1 if spec.global_dispersion else n)}
        if spec.likelihoods[m] == "gaussian":
            glo |= {f"sd_loc_{m}": np.zeros((1, n)), f"sd_raw_{m}": at(1, n)}
        if spec.levels:
            glo |= {f"gate_loc_{m}": np.zeros((k, 1)), f"gate_raw_{m}": at(k, 1), f"level_loc_{m}": np.zeros((spec.levels, n)), f"level_raw_{m}": at(spec.levels, n)}
    if spec.weight_mode == "universal" and spec.aggregation == "moe":
        enc["mod_w"] = np.ones(len(spec.sizes))
    if spec.aggregation == "attention":
        enc |= {"att_w": rng.normal(0, np.sqrt(2 / (k + spec.att_dim)), (k, spec.att_dim)), "att_v": rng.normal(0, np.sqrt(2 / (spec.att_dim + 1)), (spec.att_dim, 1))}
    return enc, glo


# ---- topics and features


def normal_kl(mean: Var, sd: Var, mean0, sd0) -> Var:
    return (A.log(sd0 / sd) + (sd * sd + (mean - mean0) * (mean - mean0)) / (2 * np.square(sd0)) - 0.5).sum()


def half_cauchy(v: Var) -> Var:
    return (np.log(2 / np.pi) - A.log(1 + v * v)).sum()


def inverse_gamma_half(v: Var) -> Var:
    return (0.5 * np.log(0.5) - 0.5 * np.log(np.pi) - 1.5 * A.log(v) - 0.5 / v).sum()


def beta_half(v: Var) -> Var:
    return (-np.log(np.pi) - 0.5 * A.log(v) - 0.5 * A.log(1 - v)).sum()


def student_t10(v: Var, scale: float = 0.01) -> Var:
    from math import lgamma

    return (lgamma(5.5) - lgamma(5) - 0.5 * np.log(10 * np.pi) - np.log(scale) - 5.5 * A.log(1 + v * v / (10 * scale**2))).sum()


def drawn(spec: Spec, glo: dict[str, Var], init_bg: list[np.ndarray], noise: Params) -> tuple[dict[str, Var], Var]:
    """What the cells' likelihoods need of topics and features at these draws, and the divergence of their posteriors."""
    out, kl = {}, Var(0.0)

    def normal(name, mean0, sd0):
        nonlocal kl
        loc, sd = glo[f"{name.replace('_', '_loc_', 1)}"], A.softplus(glo[f"{name.replace('_', '_raw_', 1)}"])
        if sd0 is not None:
            kl = kl + normal_kl(loc, sd, mean0, sd0)
        return loc, sd, loc + sd * noise[name]

    def transformed(name, to, log_prior, log_slope):
        """A draw v = to(z) of a normal z; log_slope: log dv/dz."""
        nonlocal kl
        _, sd, z = normal(name, 0.0, None)
        v = to(z)
        kl = kl + (-0.5 * noise[name] ** 2 - _HALF_LOG_2PI - A.log(sd) - log_slope(z, v)).sum() - log_prior(v)
        return v

    log_normal = lambda name, prior: transformed(name, A.exp, prior, lambda z, v: z)
    for m, (n, kind) in enumerate(zip(spec.sizes, spec.likelihoods, strict=True)):
        if spec.prior_type == "logistic_normal":
            _, _, logits = normal(f"beta_{m}", 0.0, spec.phi_prior_sd(n))
        else:
            _, _, beta = normal(f"beta_{m}", 0.0, 1.0)
            caux, tau, delta, lam = log_normal(f"caux_{m}", inverse_gamma_half), *(log_normal(f"{x}_{m}", half_cauchy) for x in ("tau", "delta", "lam"))
            logits = beta * shrinkage(caux, tau, delta, lam)
        if spec.has_bg[m]:
            logits = logits + init_bg[m]
            if spec.learnable_bg:
                logits = logits + normal(f"bg_{m}", 0.0, 1.0)[2]
        out[f"logits_{m}"] = logits
        if f"disp_loc_{m}" in glo:
            out[f"disp_{m}"] = log_normal(f"disp_{m}", half_cauchy)
        if kind == "gaussian":
            out[f"sd_{m}"] = log_normal(f"sd_{m}", half_cauchy)
        if spec.levels:
            out[f"gate_{m}"] = transformed(f"gate_{m}", A.sigmoid, beta_half, lambda z, v: A.log(v) + A.log(1 - v))
            _, sd, v = normal(f"level_{m}", 0.0, None)
            kl = kl + (-0.5 * noise[f"level_{m}"] ** 2 - _HALF_LOG_2PI - A.log(sd)).sum() - student_t10(v)
            out[f"level_{m}"] = v
    return out, kl


def shrinkage(caux, tau, delta, lam):
    """The horseshoe's multiplier of a coefficient."""
    t, c = tau * delta * lam, caux * caux
    return A.sqrt(c * t * t / (c + t * t + 1e-8))


def noise_of(glo: Params, seed: int, step: int) -> Params:
    rng = generator(seed, step, 12)
    return {n.replace("_loc_", "_"): rng.normal(size=v.shape) for n, v in sorted(glo.items()) if "_loc_" in n}


# ---- cells


def cell_noise(ids: np.ndarray, width: int, seed: int, step: int) -> np.ndarray:
    """Standard normal numbers that follow from seed, step, cell and place: two mixed counters, then Box and Muller."""

    def uniform(part: int) -> np.ndarray:
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(part))[None, :] * np.uint64(0xD1B54A32D192ED03)
        z = z ^ np.uint64(((seed & 0xFFFFFFFF) << 32 | (step & 0xFFFFFFFF)) * 0x2545F4914F6CDD1D % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54

    with np.errstate(over="ignore"):
        return np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))


@dataclass
class Block:
    """Some cells: ids, values of each modality, encoder inputs (dense, or Rows), covariate level, own modality weights."""

    ids: np.ndarray
    x: list[np.ndarray | Rows]
    inputs: list[np.ndarray | Rows]
    level: np.ndarray
    weights: np.ndarray | None = None


@dataclass(frozen=True)
class Totals:
    """Of all cells: lower median and mean of each modality's depth, cells of the step and of all, topics' means, moments."""

    median: tuple[float, ...]
    mean: tuple[float, ...]
    n_step: int = 1
    n_all: int = 1
    theta_mean: np.ndarray | None = None
    moments: dict = field(default_factory=dict)  # batch normalisation: name -> (mean, variance)


def pre_activation(spec: Spec, enc: dict[str, Var], block: Block, m: int) -> Var:
    out = A.times(block.inputs[m], enc[f"w1_{m}"]) + enc[f"b1_{m}"]
    if f"c1_{m}" in enc:
        out = out + enc[f"c1_{m}"][block.level]
    return out


def normalised(x: Var, mean: np.ndarray, variance: np.ndarray) -> Var:
    return (x - mean) * (1 / np.sqrt(variance + 1e-5))


def hidden(spec: Spec, enc: dict[str, Var], block: Block, m: int, totals: Totals) -> Var:
    """Layer norm for plain encoders; batch norm by the moments of all cells for those of propagated features."""
    x = pre_activation(spec, enc, block, m)
    return A.relu(normalised(x, *totals.moments[f"base_{m}"]) if spec.encoder == "sgc" else A.layer_norm(x))


def location(spec: Spec, enc: dict[str, Var], h: Var, block: Block, m: int, totals: Totals) -> Var:
    out = h @ enc[f"w2_{m}"] + enc[f"b2_{m}"]
    if spec.encoder == "sgc":
        mean, variance = totals.moments[f"topic_{m}"]  # a row for each covariate level
        at = block.level if spec.levels else np.zeros(len(block.ids), np.int64)
        out = normalised(out, mean[at], variance[at]) + enc[f"shift_{m}"][at]
    return out


def encoded(spec: Spec, enc: dict[str, Var], block: Block, totals: Totals, cell_w: Var | None = None) -> tuple[Var, Var]:
    """Mean and variance of the cells' topic logits: the modalities' Gaussians, mixed."""
    means, variances, logits = [], [], []
    present = np.stack([x.sum(1) > 0 for x in block.x], 1)
    for m in range(len(spec.sizes)):
        h = hidden(spec, enc, block, m, totals)
        mean = A.clip(location(spec, enc, h, block, m, totals), -MOST, MOST)
        means.append(mean)
        variances.append(A.clip(A.softplus(h @ enc[f"w3_{m}"] + enc[f"b3_{m}"]) + VAR_EPS, LEAST_VAR, MOST))
        if spec.aggregation == "attention":
            logits.append(A.tanh(mean @ enc["att_w"]) @ enc["att_v"])
        elif spec.weight_mode == "universal":
            logits.append(enc["mod_w"][m : m + 1] + np.zeros((len(block.ids), 1)))
        elif spec.weight_mode == "cell" and cell_w is not None:
            logits.append(cell_w[:, m : m + 1])
        else:
            logits.append(Var(np.ones((len(block.ids), 1))))
    # Softmax over what the cell has; over all, if it has nothing.
    masked = [x * present[:, m : m + 1] + np.where(present[:, m : m + 1], 0.0, -MOST) for m, x in enumerate(logits)]
    top = np.max([x.value for x in masked], axis=0)
    parts = [A.exp(x - top) for x in masked]
    total = sum(parts[1:], parts[0])
    shares = [p / total for p in parts]
    mean = A.clip(sum((w * x for w, x in zip(shares, means, strict=True)), Var(0.0)), -MOST, MOST)
    variance = sum((w * (v + (x - mean) * (x - mean)) for w, x, v in zip(shares, means, variances, strict=True)), Var(0.0))
    return mean, A.clip(variance, LEAST_VAR, MOST)


def log_likelihood(spec: Spec, m: int, theta: Var, dec: dict[str, Var], block: Block, totals: Totals) -> Var:
    """Of one modality, over all cells of the block, by covariate level."""
    kind, logits, out = spec.likelihoods[m], dec[f"logits_{m}"], Var(0.0)
    for level in np.unique(block.level) if spec.levels else [None]:
        rows = slice(None) if level is None else np.flatnonzero(block.level == level)
        x = block.x[m][rows]
        own = logits if level is None else logits + dec[f"gate_{m}"] * dec[f"level_{m}"][int(level) : int(level) + 1]
        t = theta if level is None else theta[rows]
        if kind == "gaussian":
            sd = dec[f"sd_{m}"]
            z = (x - t @ own) / sd
            out = out + (-0.5 * (z * z) - A.log(sd) - _HALF_LOG_2PI).sum()
            continue
        if isinstance(x, Rows):  # multinomial
            out = out + (np.rint(np.maximum(x.val, 0)) * A.log(A.product_at(x, t, A.softmax(own, 1)) + LOG_EPS)).sum()
            continue
        rate, seen = t @ A.softmax(own, 1), np.rint(np.maximum(x, 0))
        depth = x.sum(1, keepdims=True)
        if kind == "multinomial":
            out = out + (seen * A.log(rate + LOG_EPS)).sum()
        elif kind == "bernoulli":
            seen = np.minimum(seen, 1)
            p = A.clip(rate * (depth / max(totals.mean[m], LOG_EPS)), 1e-7, 1 - 1e-7)
            out = out + (seen * A.log(p) + (1 - seen) * A.log(1 - p)).sum()
        else:
            mu = A.clip(rate * np.maximum(depth, 0), LOG_EPS, np.inf)
            r = 1 / (dec[f"disp_{m}"] * dec[f"disp_{m}"] + 1e-8) if f"disp_{m}" in dec else Var(np.full((1, 1), spec.dispersion))
            out = out + (A.lgamma(seen + r) - A.lgamma(r) - A.lgamma(Var(seen + 1)) + r * (A.log(r) - A.log(r + mu)) + seen * (A.log(mu) - A.log(r + mu))).sum()
    return out


def cell_bound(spec: Spec, enc: dict[str, Var], dec: dict[str, Var], block: Block, totals: Totals, noise: np.ndarray, kl_weight: float, cell_w: Var | None = None) -> Var:
    """The block's part of the bound, brought to all cells, and its part of the variance bonus."""
    mean, variance = encoded(spec, enc, block, totals, cell_w)
    theta = A.softmax(mean + A.sqrt(variance) * noise, 1)
    mean0, sd0 = spec.theta_prior
    out = -kl_weight * normal_kl(mean, A.sqrt(variance), mean0, sd0)
    for m, w in enumerate(spec.weights):
        out = out + float(w) * log_likelihood(spec, m, theta, dec, block, totals)
    if spec.entropy_weight:
        out = out - spec.entropy_weight * (theta * A.log(theta + LEAST_VAR)).sum()
    out = out * (totals.n_all / max(totals.n_step, 1))
    if spec.topic_variance_weight and totals.theta_mean is not None and totals.n_step > 1:
        # The topics' means are those of all cells of the step: their own change adds nothing to the gradient.
        apart = theta - totals.theta_mean
        out = out + (spec.topic_variance_weight / (totals.n_step - 1)) * (apart * apart).sum()
    return out


def leaves(params: Params) -> dict[str, Var]:
    return {n: Var(v) for n, v in params.items()}


# ---- data


_ROW = "cell_id long, idx array<int>, val array<double>, hidx array<int>, hval array<double>, level int, w array<double>"


def rows_of(data: TopicData, spec: Spec, covariate: str | None = None, propagated: DataFrame | None = None) -> DataFrame:
    """A row for each cell: its non-zeros by global feature index, propagated values by place, level, own weights' state.

    propagated: (cell_id, place, value), looked up by cell. A cell's arrays are bounded by its features.
    """
    at = data.features().select("modality", "feature", "global_idx")
    pairs = lambda i, v: F.sort_array(F.collect_list(F.struct(F.col(i).cast("int").alias("i"), F.col(v).cast("double").alias("v")))).alias("e")
    entries = data.counts.where("value <> 0").join(at, ["modality", "feature"]).groupBy("cell_id").agg(pairs("global_idx", "value"))
    cells = data.cells.select(F.col("cell_id").cast("long").alias("cell_id"), *([F.col(covariate)] if covariate else []))
    if covariate:
        from .prep import covariate_codes

        cells = cells.join(covariate_codes(cells, covariate), covariate, "left").select("cell_id", F.coalesce(F.col("code").cast("int"), F.lit(0)).alias("level"))
    else:
        cells = cells.withColumn("level", F.lit(0))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    rows = cells.join(entries, "cell_id", "left")
    rows = rows.select("cell_id", "level", F.coalesce(F.col("e.i"), empty("int")).alias("idx"), F.coalesce(F.col("e.v"), empty("double")).alias("val"))
    if propagated is None:
        rows = rows.withColumns({"hidx": empty("int"), "hval": empty("double")})
    else:
        far = propagated.where("value <> 0").groupBy("cell_id").agg(pairs("place", "value"))
        rows = rows.join(far, "cell_id", "left").withColumns({"hidx": F.coalesce(F.col("e.i"), empty("int")), "hval": F.coalesce(F.col("e.v"), empty("double"))}).drop("e")
    own = F.concat(F.array_repeat(F.lit(1.0), len(spec.sizes)), F.array_repeat(F.lit(0.0), 2 * len(spec.sizes)))
    return rows.select("cell_id", "idx", "val", "hidx", "hval", "level", own.alias("w"))


def propagated_features(data: TopicData, graph: DataFrame, hops: int = 1) -> DataFrame:
    """(cell_id, place, value): log of counts smoothed 0 to hops times over the graph, the hops of a modality side by side."""
    from .graph import sgc

    at, out = data.features().select("modality", "feature", "feature_idx"), None
    sizes = {r.modality: r.n for r in at.groupBy("modality").agg(F.count("*").alias("n")).collect()}
    before = 0
    for m in data.modalities:
        own = F.col("modality") == m
        counts = data.counts.where(own).join(at.where(own).select("feature", "feature_idx"), "feature").select("cell_id", F.col("feature_idx").alias("feature"), "value")
        rows = sgc(counts, graph, data.cells, hops).select("cell_id", (F.col("feature") + F.col("hop") * sizes[m] + before).alias("place"), "value")
        before, out = before + sizes[m] * (hops + 1), rows if out is None else out.unionByName(rows)
    return out


def _bounds(spec: Spec) -> tuple[np.ndarray, np.ndarray, int]:
    """Ends of the modalities' features and of their encoders' places, and the cells of a block."""
    far = spec.hops + 1 if spec.encoder == "sgc" else 1
    wide = sum(spec.n_hidden + (0 if kind == "multinomial" else n * (1 + far)) for n, kind in zip(spec.sizes, spec.likelihoods, strict=True))
    return np.cumsum([0, *spec.sizes]), np.cumsum([0, *(n * far for n in spec.sizes)]), max(1, BLOCK // max(wide, 1))


def _block(spec: Spec, totals: Totals, ids: np.ndarray, counts: K.Sparse, far: K.Sparse, level: np.ndarray, weights: np.ndarray) -> Block:
    ends, places, _ = _bounds(spec)

    def parts(x: K.Sparse, bounds: np.ndarray) -> list[np.ndarray | Rows]:
        out = []
        for kind, a, b in zip(spec.likelihoods, bounds, bounds[1:], strict=False):
            mine = np.flatnonzero((x.idx >= a) & (x.idx < b))
            own = Rows(x.row[mine], x.idx[mine] - a, x.val[mine], (x.cells, int(b - a)))
            out.append(own if kind == "multinomial" else _dense(own))
        return out

    x = parts(counts, ends)
    if spec.encoder == "sgc":
        inputs = parts(far, places)
    else:
        inputs = [p if kind == "gaussian" or not spec.normalize_inputs else _normalised_input(p, mid) for p, kind, mid in zip(x, spec.likelihoods, totals.median, strict=True)]
    return Block(ids, x, inputs, level, weights)


def blocks(batches, spec: Spec, totals: Totals):
    """Blocks of cells: BLOCK values at most of dense modalities and hidden units, and non-zeros of multinomial ones."""
    step = _bounds(spec)[2]
    for batch in batches:
        for a in range(0, len(batch), step):
            some = batch.iloc[a : a + step]
            far = sparse(some.assign(idx=some["hidx"], val=some["hval"])) if spec.encoder == "sgc" else None
            yield some, _block(spec, totals, some["cell_id"].to_numpy(np.int64), sparse(some), far, some["level"].to_numpy(np.int64), np.stack(some["w"]))


def _held_blocks(held: dict[str, np.ndarray], weights: np.ndarray, spec: Spec, totals: Totals):
    """The same of a part's arrays."""
    step = _bounds(spec)[2]

    def cut(c: str, v: str, a: int, b: int) -> K.Sparse:
        ends = held[f"{c}-ends"]
        return K.Sparse(np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), held[c][ends[a] : ends[b]].astype(np.int64), held[v][ends[a] : ends[b]], b - a)

    for a in range(0, len(weights), step):
        b = min(len(weights), a + step)
        far = cut("hidx", "hval", a, b) if spec.encoder == "sgc" else None
        yield _block(spec, totals, held["cell_id"][a:b], cut("idx", "val", a, b), far, held["level"][a:b].astype(np.int64), weights[a:b])


def _over(cells: DataFrame | Parts, spec: Spec, totals: Totals, task, schema: str) -> DataFrame:
    """The frames that task(blocks) yields for each task's cells."""
    if not isinstance(cells, Parts):
        return cells.mapInPandas(lambda batches: task(block for _, block in blocks(batches, spec, totals)), schema)

    def run(held, weights):
        for frame in task(_held_blocks(held, weights, spec, totals)):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return cells.map(run, schema)


def _dense(x: Rows) -> np.ndarray:
    out = np.zeros(x.shape)
    out[x.row, x.idx] = x.val
    return out


def _normalised_input(x: np.ndarray | Rows, median: float) -> np.ndarray | Rows:
    """log(1 + share of the cell's depth, brought to the median depth)."""
    depth = np.maximum(x.sum(1, keepdims=True), 1)
    if isinstance(x, Rows):
        return x.with_values(np.log1p(np.maximum(x.val, 0) / depth[x.row, 0] * median))
    return np.log1p(np.maximum(x, 0) / depth * median)


# ---- passes


def _pieces(total: np.ndarray) -> pd.DataFrame:
    """(i, g): pieces of PIECE numbers that aren't all 0, as bytes."""
    starts = [a for a in range(0, len(total), PIECE) if total[a : a + PIECE].any()]
    return pd.DataFrame({"i": [a // PIECE for a in starts], "g": [total[a : a + PIECE].tobytes() for a in starts]})


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of (i, g) rows of _pieces; as many numbers as there are parameters come to the driver."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "g": [np.sum([np.frombuffer(g) for g in group["g"]], axis=0).tobytes()]})

    out = np.zeros(size)
    for r in rows.groupBy("i").applyInPandas(add, "i long, g binary").collect():  # parameters
        g = np.frombuffer(r.g)
        out[r.i * PIECE : r.i * PIECE + len(g)] = g
    return out


def moments(cells: DataFrame, spec: Spec, enc: Params, totals: Totals) -> Totals:
    """Batch normalisation's means and variances, of hidden units over all cells and of topics for each covariate level."""
    levels, k, h = max(spec.levels, 1), spec.n_topics, spec.n_hidden

    def one(name: str, rows: int, width: int, values) -> dict:
        def run(blocks):
            sums = np.zeros((len(spec.sizes), rows, 2 * width + 1))
            p = leaves(enc)
            for block in blocks:
                for m in range(len(spec.sizes)):
                    at, v = values(p, block, m)
                    np.add.at(sums[m], at, np.hstack([v, v * v, np.ones((len(v), 1))]))
            yield _pieces(sums.ravel())

        got = _summed(_over(cells, spec, totals, run, "i long, g binary"), len(spec.sizes) * rows * (2 * width + 1)).reshape(len(spec.sizes), rows, -1)
        n = np.maximum(got[:, :, -1:], 1)
        mean = got[:, :, :width] / n
        # A level of a single cell, as one without any, is left as it is.
        few, spread = got[:, :, -1:] <= 1, np.maximum(got[:, :, width : 2 * width] / n - mean**2, 0)
        return {f"{name}_{m}": (np.where(few, 0.0, mean)[m], np.where(few, 1.0, spread)[m]) for m in range(len(spec.sizes))}

    zeros = lambda block: np.zeros(len(block.ids), np.int64)
    totals = replace(totals, moments=one("base", 1, h, lambda p, block, m: (zeros(block), pre_activation(spec, p, block, m).value)))

    def located(p, block, m):
        return (block.level if spec.levels else zeros(block)), (hidden(spec, p, block, m, totals) @ p[f"w2_{m}"] + p[f"b2_{m}"]).value

    return replace(totals, moments=totals.moments | one("topic", levels, k, located))


def theta_sums(cells: DataFrame, spec: Spec, enc: Params, totals: Totals, seed: int, step: int) -> tuple[np.ndarray, int]:
    """Topics' means at the step's draws, and the number of its cells."""

    def run(blocks):
        sums, p = np.zeros(spec.n_topics + 1), leaves(enc)
        for block in blocks:
            mean, variance = encoded(spec, p, block, totals, Var(block.weights[:, : len(spec.sizes)]))
            theta = K.softmax(mean.value + np.sqrt(variance.value) * cell_noise(block.ids, spec.n_topics, seed, step))
            sums += np.append(theta.sum(0), len(theta))
        yield pd.DataFrame({"sums": [sums]})

    got = sum((np.array(r.sums) for r in _over(cells, spec, totals, run, "sums array<double>").collect()), np.zeros(spec.n_topics + 1))  # a row for each task
    return got[:-1] / max(got[-1], 1), int(got[-1])


@dataclass
class State:
    """Everything from which a fit goes on: parameters, their moments in the optimiser, counters and histories."""

    params: Params
    first: Params
    second: Params
    step: int = 0
    epoch: int = 0
    history: dict[str, list[float]] = field(default_factory=dict)
    best: Params | None = None
    best_value: float = float("inf")
    waited: int = 0


def adam(params: Params, grads: Params, first: Params, second: Params, t: int, rate: float, decay: float) -> None:
    """A step up the gradients, in place; decay is decoupled."""
    for n, g in grads.items():
        first[n] = 0.9 * first[n] + 0.1 * g
        second[n] = 0.999 * second[n] + 0.001 * g * g
        params[n] = params[n] * (1 - rate * decay) + rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)


def _flat(spec: Spec, enc: Params, dec: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = [*sorted(enc), *sorted(dec)]
    return names, np.cumsum([0, *((enc | dec)[n].size for n in names)])


def _narrowed(enc: Params, block: Block) -> tuple[dict[str, Var], dict[str, np.ndarray]]:
    """The encoders' parameters for a block, which is changed to match: of first layers that read Rows those rows alone that its
    cells have, with their places."""
    p, at = leaves(enc), {}
    for m, x in enumerate(block.inputs):
        if isinstance(x, Rows):
            at[f"w1_{m}"], idx = np.unique(x.idx, return_inverse=True)
            block.inputs[m] = Rows(x.row, idx, x.val, (x.shape[0], len(at[f"w1_{m}"])))
            p[f"w1_{m}"] = Var(enc[f"w1_{m}"][at[f"w1_{m}"]])
    return p, at


def data_gradient(cells: DataFrame | Parts, spec: Spec, enc: Params, dec: Params, totals: Totals, seed: int, step: int, kl_weight: float, rate: float = 0.0, t: int = 1, decay: float = 0.0, keeps: bool = False) -> tuple[float, Params, DataFrame | Parts]:
    """The cells' part of the bound, its gradient by encoder parameters and drawn values, and the cells.

    With keeps, cells' own modality weights take a step as well; cells are Parts then.
    """
    names, ends = _flat(spec, enc, dec)
    k, shapes = len(spec.sizes), {n: v.shape for n, v in (enc | dec).items()}

    def gained(total: np.ndarray, block: Block) -> np.ndarray:
        """Adds the block's value and gradients, and gives its cells' new weights."""
        (p, at), d, own = _narrowed(enc, block), leaves(dec), Var(block.weights[:, :k])
        out = cell_bound(spec, p, d, block, totals, cell_noise(block.ids, spec.n_topics, seed, step), kl_weight, own)
        out.backward()
        total[-1] += float(out.value)
        for n, a, b in zip(names, ends, ends[1:], strict=False):
            if (g := (p | d)[n].grad) is not None:
                if n in at:
                    total[a:b].reshape(shapes[n])[at[n]] += g
                else:
                    total[a:b] += g.ravel()
        if not keeps:
            return block.weights
        state = {x: {"w": block.weights[:, j * k : (j + 1) * k]} for j, x in enumerate(("w", "m", "v"))}
        adam(state["w"], {"w": own.grad if own.grad is not None else np.zeros_like(own.value)}, state["m"], state["v"], t, rate, decay)
        return np.hstack([state[x]["w"] for x in ("w", "m", "v")])

    def run(blocks):
        total = np.zeros(int(ends[-1]) + 1)
        for block in blocks:
            gained(total, block)
        yield _pieces(total)

    def of_part(held, weights):
        total = np.zeros(int(ends[-1]) + 1)
        new = [gained(total, block) for block in _held_blocks(held, weights, spec, totals)]
        yield pa.RecordBatch.from_pandas(_pieces(total), schema=pa.schema([("i", pa.int64()), ("g", pa.binary())]), preserve_index=False)
        return np.concatenate(new)

    rows = cells.map(of_part, "i long, g binary", keeps=True) if keeps else _over(cells, spec, totals, run, "i long, g binary")
    got = _summed(rows, int(ends[-1]) + 1)
    return float(got[-1]), {n: got[a:b].reshape(shapes[n]) for n, a, b in zip(names, ends, ends[1:], strict=False)}, cells.kept() if keeps else cells


def bound(cells: DataFrame, spec: Spec, enc: Params, glo: Params, init_bg: list[np.ndarray], totals: Totals, seed: int, step: int, kl_weight: float) -> tuple[float, Params, Params, dict]:
    """The bound at the step's draws, and its gradients by encoder and posterior parameters."""
    g = leaves(glo)
    values, kl = drawn(spec, g, init_bg, noise_of(glo, seed, step))
    dec = {n: v.value for n, v in values.items()}
    value, grads, cells = data_gradient(cells, spec, enc, dec, totals, seed, step, kl_weight)
    return value - kl_weight * float(kl.value), {n: grads[n] for n in enc}, _posterior_gradient(g, values, kl, grads, kl_weight), grads


def _posterior_gradient(g: dict[str, Var], values: dict[str, Var], kl: Var, grads: Params, kl_weight: float) -> Params:
    """What the draws' gradients and the divergence say of the posteriors' parameters."""
    root = -kl_weight * kl
    for n, v in values.items():
        root = root + (v * grads[n]).sum()
    root.backward()
    return {n: v.grad if v.grad is not None else np.zeros(v.shape) for n, v in g.items()}


# ---- fit


def warm_up(epoch: int, epochs: int, final: float, share: float = 0.25, least: float = 0.01) -> float:
    """The divergence's weight: it grows from `least` over the first share of the epochs."""
    n = max(1, int(epochs * share))
    return final if share <= 0 or epoch >= n else least + epoch / n * (final - least)


def stop_early(state: State, value: float, patience: int | None, min_delta: float = 0.0) -> bool:
    """Takes in a validation loss: keeps the parameters of the lowest, and says whether `patience` epochs brought none lower."""
    if value < state.best_value - min_delta:
        state.best, state.best_value, state.waited = {n: v.copy() for n, v in state.params.items()}, value, 0
    else:
        state.waited += 1
    return patience is not None and state.waited >= patience


def spec_of(data: TopicData, likelihoods: dict[str, str] | None = None, covariate: str | None = None, **kw) -> Spec:
    """The checked specification for data: every value must suit its modality's likelihood."""
    kinds = data.default_likelihoods() | (likelihoods or {})
    data.validate(kinds)
    sizes = {r.modality: r.n for r in data.features().groupBy("modality").agg(F.count("*").alias("n")).collect()}
    levels = data.cells.select(one_covariate(data.cells, [covariate])).distinct().count() if covariate else 0
    return Spec(tuple(data.modalities), tuple(sizes[m] for m in data.modalities), tuple(kinds[m] for m in data.modalities), levels=levels, **kw)


def totals_of(data: TopicData, spec: Spec) -> Totals:
    from .prep import library_sizes

    got = library_sizes(data.counts, data.cells).groupBy("modality").agg(F.expr("percentile_disc(0.5) within group (order by greatest(lib, 1d))").alias("mid"), F.avg("lib").alias("mean")).collect()
    by = {r.modality: r for r in got}
    return Totals(tuple(float(by[m].mid) for m in spec.modalities), tuple(float(by[m].mean) for m in spec.modalities))


def background_of(data: TopicData, spec: Spec, n_cells: int) -> list[np.ndarray]:
    from .prep import feature_background

    if not any(spec.has_bg):
        return [np.zeros((1, n)) for n in spec.sizes]
    rows = feature_background(data.counts, n_cells).join(data.features(), ["modality", "feature"]).select("modality", "feature_idx", "background").toPandas()
    out = [np.full((1, n), np.log(1e-15)) for n in spec.sizes]
    for m, name in enumerate(spec.modalities):
        own = rows[rows["modality"] == name]
        out[m][0, own["feature_idx"].to_numpy(int)] = own["background"].to_numpy(float)
    return out


def fit_amortised(data: TopicData, n_epochs: int = 30, rate: float = 1e-2, decay: float = 0.01, steps_per_epoch: int = 1, warmup: float = 0.25, validation: float = 0.0, patience: int | None = None, likelihoods: dict[str, str] | None = None, covariate: str | None = None, graph: str | None = None, seed: int = 0, resume: AmortisedModel | None = None, **spec) -> AmortisedModel:
    """Fits the model; further arguments are those of Spec.

    A share `validation` of the cells, by a hash of their id, is held out: after each epoch their loss is taken at fixed
    draws and the full weight of the divergence, the best parameters are kept, and the fit ends when `patience` epochs
    brought none better. graph names the edges whose propagated features the encoder "sgc" reads. resume goes on from a
    model's state up to n_epochs; the result is that of an unbroken fit.
    """
    data = data.indexed()
    how = resume.spec if resume else spec_of(data, likelihoods, covariate, **spec, **({"encoder": "sgc"} if graph else {}))
    seed = resume.seed if resume else seed
    far = None
    if graph:
        if data.graph(graph) is None:
            raise KeyError(f"no graph {graph!r}; there are {sorted(data.edges)}")
        far = propagated_features(data, data.graph(graph), how.hops)
    rows = resume.rows if resume else rows_of(data, how, covariate, far)
    rows = checkpointed(rows) if validation or steps_per_epoch > 1 or far is not None else rows
    held = F.pmod(F.xxhash64(F.lit(seed), "cell_id"), F.lit(10_000)) < int(validation * 10_000)
    part = F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(steps_per_epoch)).cast("int")
    train = rows.where(~held) if validation else rows
    own_weights = how.weight_mode == "cell" and how.aggregation == "moe" and len(how.sizes) > 1
    # Parts for each step of an epoch: a step reads its own cells only.
    ids, entries = rows.select("cell_id") if resume else data.cells, entries_of(data.counts) // steps_per_epoch
    groups = [Parts.of(train.where(part == s), ids, "w", ("idx", "val", "hidx", "hval"), ("cell_id", "level"), entries) for s in range(steps_per_epoch)]
    n_all = sum(g.cells for g in groups)
    totals, init_bg = (resume.totals, resume.init_bg) if resume else (replace(totals_of(data, how), n_all=n_all), background_of(data, how, data.cells.count()))
    if resume:
        state = resume.state
    else:
        enc, glo = start(how, seed)
        params = enc | glo
        state = State(params, {n: np.zeros_like(v) for n, v in params.items()}, {n: np.zeros_like(v) for n, v in params.items()}, history={"elbo_train": [], "elbo_val": []})
    mine, theirs = [n for n in state.params if "_loc_" not in n and "_raw_" not in n], [n for n in state.params if "_loc_" in n or "_raw_" in n]
    while state.epoch < n_epochs:
        kl, losses = warm_up(state.epoch, n_epochs, how.kl_weight, warmup), []
        for s in range(steps_per_epoch):
            state.step += 1
            enc, glo = {n: state.params[n] for n in mine}, {n: state.params[n] for n in theirs}
            now = moments(groups[s], how, enc, totals) if how.encoder == "sgc" else totals
            mean, n_step = theta_sums(groups[s], how, enc, now, seed, state.step)
            if not n_step:
                continue
            now = replace(now, theta_mean=mean, n_step=n_step)
            g = leaves(glo)
            values, kl_value = drawn(how, g, init_bg, noise_of(glo, seed, state.step))
            value, grads, groups[s] = data_gradient(groups[s], how, enc, {n: v.value for n, v in values.items()}, now, seed, state.step, kl, rate, state.epoch + 1, decay, own_weights)
            grads = {n: grads[n] for n in mine} | _posterior_gradient(g, values, kl_value, grads, kl)
            adam(state.params, grads, state.first, state.second, state.step, rate, decay)
            losses.append(kl * float(kl_value.value) - value)
        state.epoch += 1
        state.history["elbo_train"].append(float(np.mean(losses)) if losses else float("nan"))
        if validation:
            enc, glo = {n: state.params[n] for n in mine}, {n: state.params[n] for n in theirs}
            state.history["elbo_val"].append(loss(rows.where(held), how, enc, glo, init_bg, totals, seed))
            if stop_early(state, state.history["elbo_val"][-1], patience):
                break
    if state.best is not None:
        state.params = {n: v.copy() for n, v in state.best.items()}
    trained = groups[0].frame("w")
    for g in groups[1:]:
        trained = trained.unionByName(g.frame("w"))
    return AmortisedModel.of(data, how, state, trained.unionByName(rows.where(held)) if validation else trained, init_bg, totals, seed)


def loss(cells: DataFrame, spec: Spec, enc: Params, glo: Params, init_bg: list[np.ndarray], totals: Totals, seed: int) -> float:
    """The negative bound of some cells at fixed draws, as if they were all; NaN without cells."""
    now = moments(cells, spec, enc, totals) if spec.encoder == "sgc" else totals
    mean, n = theta_sums(cells, spec, enc, now, seed, 0)
    if not n:
        return float("nan")
    return -bound(cells, spec, enc, glo, init_bg, replace(now, theta_mean=mean, n_step=n, n_all=n), seed, 0, spec.kl_weight)[0]


@dataclass
class AmortisedModel(TopicModel):
    spec: Spec | None = None
    state: State | None = None
    rows: DataFrame | None = None
    init_bg: list[np.ndarray] = field(default_factory=list)
    totals: Totals | None = None
    seed: int = 0

    @classmethod
    def of(cls, data, spec, state, rows, init_bg, totals, seed) -> AmortisedModel:
        kinds = {m: "bernoulli" if k == "bernoulli" else "multinomial" for m, k in zip(spec.modalities, spec.likelihoods, strict=True)}
        out = cls(data, spec.n_topics, rows, np.zeros((0, 0)), state.history, kinds, spec=spec, state=state, rows=rows, init_bg=init_bg, totals=totals, seed=seed)
        out.phi_matrix = np.vstack([out.feature_topics(m, n_samples=0).T for m in spec.modalities])
        out.cells = rows.select("cell_id", "idx", "val").join(out.latents(), "cell_id")
        return out

    def _split(self) -> tuple[Params, Params]:
        mine = lambda n: "_loc_" in n or "_raw_" in n
        return {n: v for n, v in self.state.params.items() if not mine(n)}, {n: v for n, v in self.state.params.items() if mine(n)}

    def latents(self, ids: list[int] | None = None, n_samples: int = 0) -> DataFrame:
        """(cell_id, theta) of all cells or those with the given ids: softmax of the mean, or its mean over draws."""
        spec, (enc, _), seed = self.spec, self._split(), self.seed
        totals = moments(self.rows, spec, enc, self.totals) if spec.encoder == "sgc" else self.totals

        def run(batches):
            p = leaves(enc)
            for some, block in blocks(batches, spec, totals):
                mean, variance = encoded(spec, p, block, totals, Var(block.weights[:, : len(spec.sizes)]))
                theta = K.softmax(mean.value) if not n_samples else sum(K.softmax(mean.value + np.sqrt(variance.value) * cell_noise(block.ids, spec.n_topics, seed, -1 - i)) for i in range(n_samples)) / n_samples
                yield pd.DataFrame({"cell_id": some["cell_id"], "theta": list(theta)})

        rows = self.rows if ids is None else self.rows.where(F.col("cell_id").isin(list(ids)))
        return rows.mapInPandas(run, "cell_id long, theta array<double>")

    def get_latent_representation(self, ids: list[int] | None = None, n_samples: int = 100) -> DataFrame:
        return self.latents(ids, n_samples).select("cell_id", F.posexplode("theta").alias("k", "theta"))

    get_cell_topic_dist = get_latent_representation

    def feature_topics(self, modality: str, n_samples: int = 100) -> np.ndarray:
        """Topics by features: the mean of softmax over draws of the logits (at their mean without draws); for continuous
        values of the logits themselves."""
        m = self.spec.modalities.index(modality)
        p = self.state.params
        scale = lambda n: np.logaddexp(0, p[f"{n}_raw_{m}"])
        fixed = self.init_bg[m] + p.get(f"bg_loc_{m}", 0.0) if self.spec.has_bg[m] else 0.0
        loc, sd = p[f"beta_loc_{m}"], scale("beta")
        if self.spec.prior_type == "horseshoe":
            parts = [Var(np.exp(p[f"{n}_loc_{m}"] + scale(n) ** 2 / 2)) for n in ("caux", "tau", "delta", "lam")]
            shrink = shrinkage(*parts).value
            loc, sd = loc * shrink, sd * shrink
        ends = (lambda z: z) if self.spec.likelihoods[m] == "gaussian" else K.softmax
        if not n_samples:
            return ends(loc + fixed)
        rng = generator(self.seed, 0, 13 + m)
        return sum(ends(loc + sd * rng.normal(size=loc.shape) + fixed) for _ in range(n_samples)) / n_samples

    def get_feature_topic_dist(self, modality: str | None = None, n_samples: int = 100) -> dict[str, np.ndarray]:
        """By modality, topics by features."""
        return {m: self.feature_topics(m, n_samples) for m in ([modality] if modality else self.spec.modalities)}

    def get_elbo(self, ids: list[int] | None = None) -> float:
        """The bound of all cells, or of those with the given ids as if they were all, at fixed draws."""
        rows = self.rows if ids is None else self.rows.where(F.col("cell_id").isin(list(ids)))
        return -loss(rows, self.spec, *self._split(), self.init_bg, self.totals, self.seed)

    def get_modality_weights(self) -> DataFrame:
        """(cell_id, modality, weight): the cells' own weights, by softmax over what they have."""
        spec, totals, k = self.spec, self.totals, len(self.spec.sizes)

        def run(batches):
            for _, block in blocks(batches, spec, totals):
                present = np.stack([x.sum(1) > 0 for x in block.x], 1)
                share = K.softmax(np.where(present, block.weights[:, :k], -MOST))
                yield pd.DataFrame({"cell_id": np.repeat(block.ids, k), "modality": list(spec.modalities) * len(block.ids), "weight": share.ravel()})

        return self.rows.mapInPandas(run, "cell_id long, modality string, weight double")

    def get_state(self) -> dict[str, np.ndarray]:
        """Copies of all parameters by name."""
        return {n: v.copy() for n, v in self.state.params.items()}

    def save(self, path: str) -> None:
        """Parameters, optimiser, counters, histories and cells under path, from which load() goes on bit for bit."""
        spark, s = self.rows.sparkSession, self.state
        arrays = [(kind, n, list(v.shape), v.ravel().tolist()) for kind, group in (("params", s.params), ("first", s.first), ("second", s.second), ("best", s.best or {})) for n, v in group.items()]
        arrays += [("background", str(m), list(v.shape), v.ravel().tolist()) for m, v in enumerate(self.init_bg)]
        spark.createDataFrame(arrays, "kind string, name string, shape array<int>, value array<double>").write.mode("overwrite").parquet(f"{path}/arrays")
        told = {"version": 1, "spec": asdict(self.spec), "step": s.step, "epoch": s.epoch, "history": s.history, "best_value": s.best_value, "waited": s.waited, "seed": self.seed, "median": self.totals.median, "mean": self.totals.mean, "n_all": self.totals.n_all}
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        self.rows.write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, data: TopicData, path: str) -> AmortisedModel:
        spark = data.counts.sparkSession
        told = json.loads(spark.read.text(f"{path}/state").head()[0])
        if told["version"] != 1:
            raise ValueError(f"{path}: version {told['version']} isn't known")
        held: dict[str, Params] = {}
        for r in spark.read.parquet(f"{path}/arrays").collect():  # parameters
            held.setdefault(r.kind, {})[r.name] = np.array(r.value, dtype=np.float64).reshape(r.shape)
        spec = Spec(**{n: tuple(v) if isinstance(v, list) else v for n, v in told["spec"].items()})
        state = State(held["params"], held["first"], held["second"], told["step"], told["epoch"], told["history"], held.get("best"), told["best_value"], told["waited"])
        totals = Totals(tuple(told["median"]), tuple(told["mean"]), n_all=told["n_all"])
        bg = [held["background"][str(m)] for m in range(len(spec.sizes))]
        return cls.of(data, spec, state, spark.read.schema(_ROW).parquet(f"{path}/cells"), bg, totals, told["seed"])
