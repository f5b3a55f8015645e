"""What the operators share: the shared folder, written intermediate tables, words and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator holds at a time, whatever the size of Spark's Arrow batches.
SLICE_ROWS = 256


#: Bytes of a batch that Spark sends to a Python worker, where the cluster sets no other number.
BATCH_BYTES = 4 << 20

_kept: dict = {}


def kept(name, make):
    """What a Python worker keeps for an operator's later tasks; another operator's things are let go first."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Return freed memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES: a batch of 10,000 long texts takes several times its size on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where a local session names none, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        at = f"file://{tempfile.mkdtemp(prefix='topicloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def nested(documents: DataFrame) -> DataFrame:
    """(document, text): all columns in one struct, so that their names clash with none that an operator makes."""
    return documents.select(F.struct(*map(named, documents.columns)).alias("document"), "text")


@cache
def hold_little() -> None:
    """In a Python worker: blocks of 1 MB and more go back to the system as soon as they are freed (M_MMAP_THRESHOLD)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    hold_little()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: A hash with so many entries among the 750,000 that a task packs at a time is frequent: its owners are spread over tasks.
#: So a hash's entries in one bucket are a 2930th of all at most; there are 512 buckets or more, and more with more rows.
FREQUENT = 256


def frequent(hashes: np.ndarray, least: int) -> np.ndarray:
    """Of sorted hashes: which occur `least` times or more."""
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    n = np.diff([*begins, len(hashes)])
    return np.repeat(n >= least, n)


def by_group(groups: np.ndarray, *columns: np.ndarray) -> dict[int, list[np.ndarray]]:
    """The columns' rows of each group, in their order."""
    order = np.argsort(groups, kind="stable")
    found, first = np.unique(groups[order], return_index=True)
    columns = [c[order] for c in columns]
    return {int(g): [c[a:b] for c in columns] for g, a, b in zip(found, first, [*first[1:], len(groups)][: len(found)], strict=True)}


def row_key(doc_id: str = "doc_id") -> Column:
    """A 64-bit key of a row's doc_id and text. Rows equal in both have one key; that others have it too is left to chance."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(doc_id).isNull(), F.col("text"), F.col("text").isNull())


#: Bits of the filter that likely() broadcasts: 16 for each wanted id, 16 MB in all at most.
FILTER_BITS = 1 << 27


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap of so many bits, set at the places (p from 1 on)."""
    filled = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    raw = np.zeros(bits // 8, dtype=np.uint8)
    for r in filled:
        raw[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return raw


def bitmap_bits(n: int) -> int:
    """16 bits for each of n keys, within bounds."""
    return min(FILTER_BITS, 1 << max(15, (16 * n - 1).bit_length()))


def likely(rows: DataFrame, column: str, wanted: DataFrame, then, schema: str) -> DataFrame:
    """then, in the same worker, over the rows whose id in column may be among those of wanted, by a hashed bitmap.

    All rows of wanted ids stay, and a few others; with more wanted ids than the bitmap has room for, more others. What
    follows must drop those by an exact join; it shuffles little else.
    """
    spark, key = rows.sparkSession, F.xxhash64(F.col(column).cast("long"))
    bits = bitmap_bits(wanted.count())
    at = F.pmod(key, F.lit(bits)) + 1
    shared = spark.sparkContext.broadcast(bitmap(wanted.select(at.alias("p")), bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy()
            mask = (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    return rows.withColumn("__p", at - 1).mapInArrow(lambda batches: then(keep(batches)), schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of edges (a, b), component being the smallest node reached.

    Each round every node takes its smallest neighbour, the links so taken are followed to their end, and what they join
    becomes one node of the next round. Each node joins another, so n nodes need log n rounds at most, and following takes
    log n steps; both go on until nothing is left. Every step is written to the shared folder. Edges with a null end are
    ignored.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None
    while True:
        near = both.groupBy("a").agg(F.min("b").alias("to"))
        back = near.select(F.col("a").alias("to"), F.col("to").alias("back"))
        # Links rise and fall, but smallest neighbours form no ring but of two, of which the smaller stays.
        taken = F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to"))
        tops = materialize(near.join(back, "to").select(F.col("a").alias("node"), taken.alias("label")), "cc-tops")
        while True:
            jump = tops.select(F.col("node").alias("label"), F.col("label").alias("next"))
            further = materialize(tops.join(jump, "label").select("node", F.col("next").alias("label"), F.col("label").alias("was")), "cc-tops")
            tops = further.select("node", "label")
            if not further.where("label <> was").limit(1).count():
                break
        if labels is None:
            labels = tops
        else:
            above = tops.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialize(labels.join(above, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "cc-labels")
        ends = [tops.select(F.col("node").alias(x), F.col("label").alias(f"top_{x}")) for x in "ab"]
        both = materialize(both.join(ends[0], "a").join(ends[1], "b").where("top_a <> top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct(), "cc-edges")
        if not both.limit(1).count():
            break
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return materialize(labels.join(smallest, "label").select("node", "component"), "cc-labels")
