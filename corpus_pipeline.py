"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; those may have any names besides doc_id, text, lang and
n_chars, as a stage carries them in one struct. An empty table passes through every stage. Rows without text or letters go
in the first stage. Rows without doc_id and rows that share one are rows like others, told apart by doc_id and text; of
rows that are equal in both, which all stages judge alike, the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import materialize, nested, row_key, table
from topicloom.llm.decontamination import find_hits
from topicloom.llm.jaccard_join import components
from topicloom.llm.language_id import UNKNOWN, identify
from topicloom.llm.packing import pack
from topicloom.llm.substring_dedup import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or no text) go; where lang is null, the predicted one is filled in."""
    rows = identify(nested(docs).select("document", "document.doc_id", "document.text", "document.lang"), ["document"])
    known = {c: F.col("document")[c] for c in docs.columns} | {"lang": F.coalesce(F.col("document")["lang"], "lang_pred")}
    return rows.where(F.col("lang_pred") != UNKNOWN).select([x.alias(c) for c, x in known.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays, once; rows without doc_id come last."""
    groups = components(docs.select(row_key().alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    stay = materialize(groups.join(ids, "row").groupBy("component_id").agg(first.alias("m")).select("m.row"), "first-documents")
    rows = nested(docs).select(row_key("document.doc_id").alias("row"), "document")
    return rows.join(stay, "row", "left_semi").dropDuplicates(["row"]).select("document.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat another row's are cut out; rows of which nothing is left go."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return find_hits(nested(docs), table(spark, sf_dir, "benchmark"), ["document"]).where(~F.col("contaminated")).select("document.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as pack() describes them."""
    return pack(docs)


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("decontamination", decontaminate), ("packing", packing)]

ORACLE_SQL = None  # SQL can't express language ID, chaining or packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
