"""Graph encoders: convolution and attention over neighbours, forwards and backwards, as joins over edges.

A cell's message is an array of heads x channels numbers. An edge (src, dst) says that dst hears src. Attention scores an
edge by a vector over the leaky sum of what src says and what dst asks; its weights are a softmax over all edges of dst, itself
included. Sums over a cell's edges are Spark's partial sums over single numbers, maxima likewise, so that no task holds a cell of
very many neighbours. The backward pass goes along the same edges: gradients come from dst, and are added up for src.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from .graph import gcn_normalised

# The leaky slope, and the least variance of an encoder.
SLOPE, VAR_EPS = 0.2, 1e-4


def projected(cells: DataFrame, column: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """cells (cell_id, column: array) with column @ w for each name in weights."""
    names = list(weights)

    def run(batches):
        for b in batches:
            x = np.array(b[column].tolist(), dtype=np.float64).reshape(len(b), -1)
            yield pd.DataFrame({"cell_id": b["cell_id"]} | {n: list(x @ w) for n, w in weights.items()})

    return cells.select("cell_id", column).mapInPandas(run, "cell_id long, " + ", ".join(f"{n} array<double>" for n in names))


def with_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst), once each, and every node's own."""
    own = nodes.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))
    return edges.where("src <> dst").select("src", "dst").distinct().unionByName(own)


def by_head(values: Column, heads: int) -> Column:
    """An array of heads x channels numbers summed over the channels."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.aggregate(F.slice(values, (h * n / heads).cast("int") + 1, (n / heads).cast("int")), F.lit(0.0), lambda s, v: s + v))


def spread(values: Column, like: Column, heads: int) -> Column:
    """A number for each head, repeated for its channels."""
    return F.transform(like, lambda _, i: F.element_at(values, (i * heads / F.size(like)).cast("int") + 1))


def summed_arrays(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): arrays of one length, added up place by place for each key."""
    sums = rows.select(key, F.posexplode(column).alias("at", "v")).groupBy(key, "at").agg(F.sum("v").alias("v"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias(column))  # as many as the array has


def attention(edges: DataFrame, said: DataFrame, asked: DataFrame, vector: np.ndarray, heads: int) -> DataFrame:
    """(src, dst, l, z, alpha): for each edge what src says, its sum with what dst asks, and its weights by head.

    said and asked: (cell_id, l) and (cell_id, r), arrays of heads x channels; vector scores them by head.
    """
    v = F.array(*map(F.lit, np.asarray(vector, dtype=np.float64).ravel().tolist()))
    pairs = edges.join(said.select(F.col("cell_id").alias("src"), "l"), "src").join(asked.select(F.col("cell_id").alias("dst"), "r"), "dst")
    pairs = pairs.select("src", "dst", "l", F.zip_with("l", "r", lambda a, b: a + b).alias("z"))
    scored = checkpointed(pairs.withColumn("score", by_head(F.zip_with("z", v, lambda z, a: a * F.when(z > 0, z).otherwise(SLOPE * z)), heads)))
    each = scored.select("dst", F.posexplode("score").alias("h", "s"))
    # Softmax over a cell's edges by maxima and sums of single numbers.
    top = each.groupBy("dst", "h").agg(F.max("s").alias("top"))
    norm = each.join(top, ["dst", "h"]).groupBy("dst", "h").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("s") - F.col("top"))).alias("n"))
    norm = norm.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", (F.col("top") + F.log("n")).alias("t")))), lambda e: e["t"]).alias("t"))  # as many as heads
    return scored.join(norm, "dst").select("src", "dst", "l", "z", F.zip_with("score", "t", lambda s, t: F.exp(s - t)).alias("alpha"))


def attended(weights: DataFrame, heads: int) -> DataFrame:
    """(cell_id, out): what each cell hears, by the weights of attention()."""
    heard = weights.select("dst", F.zip_with("l", spread(F.col("alpha"), F.col("l"), heads), lambda a, b: a * b).alias("out"))
    return summed_arrays(heard, "dst", "out").withColumnRenamed("dst", "cell_id")


def attended_backward(weights: DataFrame, grads: DataFrame, vector: np.ndarray, heads: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Gradients of what cells say (cell_id, g) and ask (cell_id, g), and of the vector, from grads (cell_id, g) of attended()."""
    v = np.asarray(vector, dtype=np.float64).ravel()
    rows = weights.join(grads.select(F.col("cell_id").alias("dst"), "g"), "dst")
    # Of an edge's weight: what its message adds along the gradient; of its score: less the mean of that by weight.
    rows = checkpointed(rows.withColumn("d", by_head(F.zip_with("l", "g", lambda a, b: a * b), heads)))
    mean = summed_arrays(rows.select("dst", F.zip_with("alpha", "d", lambda a, b: a * b).alias("mean")), "dst", "mean")
    rows = rows.join(mean, "dst").withColumn("ds", F.zip_with("alpha", F.zip_with("d", "mean", lambda a, b: a - b), lambda a, b: a * b))
    score = spread(F.col("ds"), F.col("z"), heads)
    slopes = F.array(*map(F.lit, v.tolist()))
    dz = F.zip_with(F.zip_with("z", slopes, lambda z, a: F.when(z > 0, a).otherwise(SLOPE * a)), score, lambda a, b: a * b)
    rows = checkpointed(rows.select("src", "dst", dz.alias("dz"), F.zip_with("g", spread(F.col("alpha"), F.col("g"), heads), lambda a, b: a * b).alias("dl"), F.zip_with("z", score, lambda z, s: s * F.when(z > 0, z).otherwise(SLOPE * z)).alias("dv")))
    said = summed_arrays(rows.select("src", F.zip_with("dl", "dz", lambda a, b: a + b).alias("g")), "src", "g").withColumnRenamed("src", "cell_id")
    asked = summed_arrays(rows.select("dst", F.col("dz").alias("g")), "dst", "g").withColumnRenamed("dst", "cell_id")
    out = np.zeros(len(v))
    for r in rows.select(F.posexplode("dv").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():  # heads x channels
        out[r["at"]] = r.v
    return said, asked, out.reshape(np.shape(vector))


def convolved(edges: DataFrame, nodes: DataFrame, said: DataFrame) -> DataFrame:
    """(cell_id, out): messages (cell_id, l) averaged over neighbours and the cell itself, by the degrees of both ends."""
    matrix = gcn_normalised(edges.select("src", "dst", F.lit(1.0).alias("weight")).distinct(), nodes)
    heard = matrix.join(said.select(F.col("cell_id").alias("dst"), "l"), "dst").select("src", F.expr("transform(l, v -> v * weight)").alias("out"))
    return summed_arrays(heard, "src", "out").withColumnRenamed("src", "cell_id")


def weight_gradient(cells: DataFrame, column: str, grads: DataFrame) -> np.ndarray:
    """X' G over all cells, for projected(); only inputs x outputs numbers reach the driver."""

    def run(batches):
        total = 0
        for b in batches:
            x, g = (np.array(b[c].tolist(), dtype=np.float64).reshape(len(b), -1) for c in (column, "g"))
            total = total + x.T @ g
        if not np.isscalar(total):
            yield pd.DataFrame({"i": np.arange(total.size), "width": total.shape[1], "v": total.ravel()})

    got = cells.select("cell_id", column).join(grads, "cell_id").mapInPandas(run, "i long, width long, v double").groupBy("i").agg(F.max("width").alias("width"), F.sum("v").alias("v")).toPandas().sort_values("i")
    return got["v"].to_numpy().reshape(-1, int(got["width"].iloc[0]))


def channel_moments(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and population variances of the places of an array over all rows."""
    got = rows.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("at").collect()
    return np.array([r.m for r in got]), np.array([r.s for r in got])


@dataclass(frozen=True)
class Layer:
    """Attention (said, asked: inputs x outputs; vector: heads x channels) or, without asked, plain convolution."""

    said: np.ndarray
    asked: np.ndarray | None = None
    vector: np.ndarray | None = None
    heads: int = 1


def encode(cells: DataFrame, edges: DataFrame, layers: list[Layer], own: np.ndarray, mean: np.ndarray, spread_: np.ndarray, mixing: float = 0.7, aligned: np.ndarray | None = None) -> DataFrame:
    """(cell_id, mean, variance) of topic logits from cells (cell_id, x) and the graph.

    h = mixing * relu(layer norm of x @ own) + (1 - mixing) * what the last layer hears, where each layer's output is
    batch-normalised by the moments of all cells, and rectified between layers; aligned brings it to own's width. Two
    heads give mean and variance: softplus and VAR_EPS. With mixing 1 the graph is not used.
    """
    if not layers or not 0 <= mixing <= 1:
        raise ValueError("at least one layer, and mixing within 0 and 1, are needed")
    heard = None
    if mixing < 1:
        nodes, loops, heard = cells.select("cell_id"), with_loops(edges, cells), cells.select("cell_id", "x")
        for i, layer in enumerate(layers):
            if layer.asked is None:
                out = convolved(edges, nodes, projected(heard, "x", {"l": layer.said}))
            else:
                both = projected(heard, "x", {"l": layer.said, "r": layer.asked})
                out = attended(attention(loops, both, both, layer.vector, layer.heads), layer.heads)
            out = checkpointed(out)
            m, s = channel_moments(out, "out")
            scaled = F.zip_with("out", F.array(*[F.struct(F.lit(float(a)).alias("m"), F.lit(float(1 / np.sqrt(b + 1e-5))).alias("w")) for a, b in zip(m, s, strict=True)]), lambda v, p: (v - p["m"]) * p["w"])
            heard = out.select("cell_id", (F.transform(scaled, lambda v: F.greatest(v, F.lit(0.0))) if i < len(layers) - 1 else scaled).alias("x"))
    rows = cells.select("cell_id", "x") if heard is None else cells.select("cell_id", "x").join(heard.withColumnRenamed("x", "far"), "cell_id")

    use = heard is not None

    def run(batches):
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=np.float64).reshape(len(b), -1) @ own
            h = mixing * np.maximum((x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5), 0)
            if use:
                far = np.array(b["far"].tolist(), dtype=np.float64).reshape(len(b), -1)
                h = h + (1 - mixing) * (far if aligned is None else far @ aligned)
            yield pd.DataFrame({"cell_id": b["cell_id"], "mean": list(h @ mean), "variance": list(np.logaddexp(0, h @ spread_) + VAR_EPS)})

    return rows.mapInPandas(run, "cell_id long, mean array<double>, variance array<double>")
