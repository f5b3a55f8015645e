"""The bundle of long tables that stands for one multimodal data set, its builders, checks, and storage."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import written

# Names of modalities and what they are written as.
SYNONYMS = {
    "rna": "rna", "genes": "rna", "transcripts": "rna",
    "adt": "protein", "protein": "protein", "prot": "protein", "proteins": "protein", "proteomics": "protein",
    "chromatin": "chromatin", "atac": "chromatin",
}


def kind_of(modality: str) -> str:
    """What a modality is, whatever it is called; unknown names stand for themselves."""
    return SYNONYMS.get(modality.lower(), modality)


def canonical_modalities(names: list[str]) -> list[str]:
    """rna, protein or chromatin for each name; unknown names and repeated meanings are errors."""
    out = []
    for name in names:
        if name.lower() not in SYNONYMS:
            raise ValueError(f"unknown modality {name!r}; known: {sorted(SYNONYMS)}")
        out.append(SYNONYMS[name.lower()])
    if len(set(out)) < len(out):
        raise ValueError(f"modalities {names} mean the same more than once: {out}")
    return out


def detect_data_type(data) -> str:
    """`bundle`, `tables` (a bundle for each table name), `dict` (a DataFrame for each modality), `frame` or `unknown`."""
    if isinstance(data, TopicData):
        return "bundle"
    if isinstance(data, DataFrame):
        return "frame"
    if isinstance(data, dict):
        if data and all(isinstance(v, TopicData) for v in data.values()):
            return "tables"
        if all(isinstance(v, DataFrame) for v in data.values()):
            return "dict"
    return "unknown"


def validate_data_type(data) -> str:
    if (kind := detect_data_type(data)) == "unknown":
        raise TypeError(f"Unsupported data type: {type(data).__name__}")
    return kind


@dataclass
class TopicData:
    """counts (cell_id, modality, feature, value), cells (cell_id, ...), graphs by name (src, dst, weight).

    Counts may have a column layer. Zeros are left out for counts and binary values, and kept for continuous ones.
    """

    counts: DataFrame
    cells: DataFrame
    modalities: list[str]
    edges: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    index: DataFrame | None = None  # features(), where they have been written

    @classmethod
    def from_counts(cls, counts: DataFrame, cells: DataFrame | None = None, modalities: list[str] | None = None, layer: str | dict | None = None, edges: dict[str, DataFrame] | None = None) -> TopicData:
        """Long counts; modalities choose and order; layer names one layer for all, or one for each modality."""
        present = sorted(r[0] for r in counts.select("modality").distinct().collect())
        names = modalities or present
        if missing := [m for m in names if m not in present]:
            raise ValueError(f"no such modalities: {missing}; present: {present}")
        counts = counts.where(F.col("modality").isin(names))
        if layer is not None:
            if "layer" not in counts.columns:
                raise KeyError(f"the counts have no layers, {layer!r} was asked for")
            wanted = layer if isinstance(layer, dict) else dict.fromkeys(names, layer)
            there = {(r.modality, r.layer) for r in counts.select("modality", "layer").distinct().collect()}
            if lost := [m for m, name in wanted.items() if (m, name) not in there]:
                raise KeyError(f"layers not found: {[(m, wanted[m]) for m in lost]}")
            test = F.lit(False)
            for m in names:
                test = test | ((F.col("modality") == m) & (F.col("layer").eqNullSafe(F.lit(wanted.get(m)))))
            counts = counts.where(test).drop("layer")
        cells = cells if cells is not None else counts.select("cell_id").distinct()
        return cls(counts, cells, list(names), edges or {}, {"layers": layer})

    @classmethod
    def from_dict(cls, frames: dict[str, DataFrame], **kw) -> TopicData:
        """A DataFrame (cell_id, feature, value) for each modality; the dict's order is the modalities'."""
        parts = [df.select("cell_id", F.lit(m).alias("modality"), "feature", F.col("value").cast("double").alias("value")) for m, df in frames.items()]
        if not parts:
            raise ValueError("no modalities")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cls.from_counts(out, modalities=list(frames), **kw)

    @classmethod
    def from_list(cls, frames: list[DataFrame], modalities: list[str], **kw) -> TopicData:
        if len(frames) != len(modalities):
            raise ValueError("as many names as frames are needed")
        return cls.from_dict(dict(zip(modalities, frames, strict=True)), **kw)

    @classmethod
    def from_tables(cls, tables: dict[str, TopicData], table_key: str) -> TopicData:
        if table_key not in tables:
            raise KeyError(f"no table {table_key!r}; there are {sorted(tables)}")
        return tables[table_key]

    @classmethod
    def from_data(cls, data, modality: str = "rna", table_key: str | None = None, **kw) -> TopicData:
        """The builder for data's kind."""
        kind = validate_data_type(data)
        if kind == "bundle":
            return data
        if kind == "tables":
            return cls.from_tables(data, table_key)
        if kind == "dict":
            return cls.from_dict(data, **kw)
        return cls.from_counts(data, **kw) if "modality" in data.columns else cls.from_dict({modality: data}, **kw)

    def features(self) -> DataFrame:
        """(modality, feature, feature_idx, global_idx): modalities in their order, features by name, counted from 0."""
        if self.index is not None:
            return self.index
        order = F.create_map(*[x for i, m in enumerate(self.modalities) for x in (F.lit(m), F.lit(i))])
        rows = self.counts.select("modality", "feature").distinct().withColumn("__o", order[F.col("modality")])
        sizes = rows.groupBy("__o").agg(F.count("*").alias("n"))  # one row for each modality
        before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__o", "offset")
        rows = rows.withColumn("feature_idx", F.row_number().over(Window.partitionBy("modality").orderBy("feature")) - 1)
        return rows.join(F.broadcast(before), "__o").select("modality", "feature", "feature_idx", (F.col("offset") + F.col("feature_idx")).alias("global_idx"))

    def indexed(self) -> TopicData:
        """The bundle with its features written once, for fits, which ask for them many times."""
        return self if self.index is not None else replace(self, index=written(self.features()))

    def graph(self, key: str) -> DataFrame | None:
        return self.edges.get(key)

    def validate(self, likelihoods: dict[str, str] | None = None) -> None:
        """One pass over the counts: no nulls, the same cells in each modality, and values that the likelihoods take."""
        likelihoods = likelihoods or {}
        for r in value_checks(self.counts).collect():  # one row for each modality
            kind = likelihoods.get(r.modality)
            if r.nulls:
                raise ValueError(f"{r.modality}: {r.nulls} values are null")
            if kind == "bernoulli" and r.not_binary:
                raise ValueError(f"{r.modality}: a Bernoulli likelihood needs values 0 and 1; {r.not_binary} are others")
            if kind not in (None, "gaussian") and r.negative:
                raise ValueError(f"{r.modality}: {r.negative} counts are negative")
        if unknown := set(likelihoods) - set(self.modalities):
            raise ValueError(f"likelihoods for modalities that aren't there: {sorted(unknown)}")

    def default_likelihoods(self) -> dict[str, str]:
        return {m: "gamma_poisson" if kind_of(m) == "rna" else "multinomial" for m in self.modalities}


def value_checks(counts: DataFrame) -> DataFrame:
    """(modality, cells, not_binary, negative, nulls): what validate() looks at, in one pass."""
    odd = ~F.col("value").isin(0.0, 1.0)
    return counts.groupBy("modality").agg(
        F.count_distinct("cell_id").alias("cells"), F.count_if(odd).alias("not_binary"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("value").isNull()).alias("nulls")
    )


def one_covariate(cells: DataFrame, categorical: list[str], continuous: list[str] = ()) -> str:
    """The one categorical covariate that batch correction takes."""
    if continuous:
        raise ValueError(f"continuous covariates are not supported: {list(continuous)}")
    if len(categorical) != 1:
        raise ValueError(f"batch correction takes exactly one categorical covariate, not {len(categorical)}")
    if categorical[0] not in cells.columns:
        raise KeyError(categorical[0])
    return categorical[0]


def misaligned_cells(counts: DataFrame) -> DataFrame:
    """(cell_id, missing): cells that some modality lacks, and how many do."""
    n = counts.select("modality").distinct().count()
    return counts.groupBy("cell_id").agg(F.count_distinct("modality").alias("here")).where(F.col("here") < n).select("cell_id", (F.lit(n) - F.col("here")).cast("long").alias("missing"))


def wide_to_long(wide: DataFrame, id_column: str) -> DataFrame:
    """(cell_id, feature, value) from one column for each feature; zeros go."""
    names = [c for c in wide.columns if c != id_column]
    long = wide.unpivot(id_column, names, "feature", "value")
    return long.select(F.col(id_column).alias("cell_id"), "feature", F.col("value").cast("double").alias("value")).where("value <> 0")


def read_tsv(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """A (gzipped) tab-separated matrix of cells by features, as long counts."""
    return wide_to_long(spark.read.csv(path, sep="\t", header=True), id_column)


_LOADERS: dict[str, Callable[..., TopicData]] = {}


def register_dataset(name: str, loader: Callable[..., TopicData]) -> None:
    _LOADERS[name] = loader


def load_dataset(name: str, *args, **kw) -> TopicData:
    if name not in _LOADERS:
        raise ValueError(f"unknown data set {name!r}; there are {sorted(_LOADERS)}")
    return _LOADERS[name](*args, **kw)


def save_model(path: str, theta: DataFrame, phi: DataFrame, metadata: dict) -> None:
    """theta and phi as Parquet, the rest as one JSON line; all under path, in any store that Spark writes."""
    theta.write.mode("overwrite").parquet(f"{path}/theta")
    phi.write.mode("overwrite").parquet(f"{path}/phi")
    theta.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/theta"), spark.read.parquet(f"{path}/phi"), json.loads(spark.read.text(f"{path}/metadata").head()[0])


def history_table(spark: SparkSession, history: dict[str, list[float]]) -> DataFrame:
    """One row for each epoch; shorter series end in nulls."""
    n = max(map(len, history.values()), default=0)
    rows = [(i, *[float(v[i]) if i < len(v) else None for v in history.values()]) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(["epoch long", *(f"`{k}` double" for k in history)]))
