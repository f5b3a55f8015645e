"""Operator 2, token-id output: a binary store of token ids with a shared zstandard dictionary.

A document's ids are little-endian unsigned 32-bit integers. Each document is compressed on its own against one
dictionary that was trained on a bounded sample of such arrays. Documents lie in ascending doc_id order in blocks of
about BLOCK_BYTES; a block is one record of the files and holds

    shard, block, block_start   its place: range partition, number there, and ids before it in the shard
    first_id, last_id           smallest and largest doc_id, so that a look-up skips other blocks
    dict_hash                   sha256 of the dictionary that its documents need
    doc_ids, counts, offsets    index: int64 ids, uint32 numbers of ids, uint64 ends of the documents in the payload
    payload                     the compressed documents, one after another

The files are Parquet files of such records beside one record with the dictionary; Spark writes them, so that they may
lie in any store and a lost task is written again. Null texts are empty documents of one id, the end id. Null doc_ids
come first; repeated ids are ordered by text. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked_encoding import encoder
from .common import new_path, slices

END_ID = 2
BLOCK_BYTES = 1 << 20
#: The dictionary's sample: documents, and bytes of each document's array.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 800, 8192, 64 << 10
#: Documents that one range of doc_ids holds, more or less.
SHARD_DOCS = 8_000
_BLOCK = "shard int, block long, block_start long, first_id long, last_id long, dict_hash string, doc_ids binary, null_ids binary, counts binary, offsets binary, payload binary"


def train_dictionary(documents: DataFrame, path: str) -> bytes:
    """A dictionary from the SAMPLE_DOCS documents of lowest id hash; empty if there is too little to train on."""
    hashed = F.xxhash64("doc_id")
    lowest = documents.select(hashed.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).head()[0]
    if lowest is None:
        return b""

    def encode(batches):
        enc = encoder(path, True)
        for some in slices(batches):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([enc.encode(t)[:SAMPLE_BYTES] for t in some.column(1).to_pylist()], pa.binary())], names=["h", "ids"])

    sample = documents.select(hashed.alias("h"), "text").where(F.col("h") <= lowest).mapInArrow(encode, "h long, ids binary").orderBy("h", "ids").limit(SAMPLE_DOCS).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r.ids) for r in sample if r.ids]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_store(documents: DataFrame, out: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> str:
    """Encode and write all documents under out; gives back out."""
    spark, path = documents.sparkSession, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    documents = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    raw = train_dictionary(documents, path)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    end = np.array([end_id], dtype="<u4").tobytes()
    shared = spark.sparkContext.broadcast(raw)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path, True), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared.value), write_content_size=True)
        number = total = 0
        ids, counts, parts, size = [], [], [], 0

        def block():
            known = [i for i in ids if i is not None]
            row = (
                shard, number, total, min(known, default=None), max(known, default=None), digest,
                np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(), np.array(counts, "<u4").tobytes(),
                np.cumsum([len(p) for p in parts], dtype="<u8").tobytes(), b"".join(parts),
            )
            return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True))], schema=SCHEMA)

        for some in slices(batches):
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                array = enc.encode(text) + end
                ids.append(doc_id)
                counts.append(len(array) // 4)
                parts.append(press.compress(array))
                size += len(parts[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    number, total = number + 1, total + sum(counts)
                    ids, counts, parts, size = [], [], [], 0
        if ids:
            yield block()

    shards = max(2, min(documents.count() // SHARD_DOCS + 1, 100_000), spark.sparkContext.defaultParallelism)
    ordered = documents.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, _BLOCK).write.option("compression", "none").parquet(f"{out}/blocks")
    return out


SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("block_start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_hash", pa.string()),
    ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("counts", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary()),
])


def _load_dictionary(spark: SparkSession, out: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{out}/dictionary").head()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError(f"{out}: the dictionary does not match its hash")
    return row.dict_hash, bytes(row.dictionary)


def documents_of(row: dict, press: zstandard.ZstdDecompressor, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the block, its array) of a block; arrays of other documents than the wanted stay compressed."""
    ids, empty = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["null_ids"], "u1")
    counts, ends = np.frombuffer(row["counts"], "<u4").astype(np.int64), np.frombuffer(row["offsets"], "<u8").astype(np.int64)
    payload, before = memoryview(row["payload"]), np.concatenate([[0], np.cumsum(counts)])
    for k, doc_id in enumerate(ids.tolist()):
        doc_id = None if empty[k] else doc_id
        if wanted is None or doc_id in wanted:
            yield doc_id, int(before[k]), press.decompress(payload[ends[k - 1] if k else 0 : ends[k]])


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before it."""
    digest, raw = _load_dictionary(spark, out)
    shared = spark.sparkContext.broadcast(raw)
    stored = spark.read.parquet(f"{out}/blocks")
    # A shard's last block tells how many ids the shard has: one row for each shard comes to the driver.
    ends = stored.select("shard", "block_start", F.expr("cast(length(counts) / 4 as int)").alias("docs"), "counts").mapInArrow(_sizes, "shard int, ids long").groupBy("shard").agg(F.sum("ids").alias("ids")).collect()
    starts, total = {}, 0
    for row in sorted(ends):
        starts[row.shard] = total
        total += row.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for one in slices(batches, 1):
            row = one.to_pylist()[0]
            if row["dict_hash"] != digest:
                raise ValueError("a block was written with another dictionary")
            got = [(i, starts[row["shard"]] + row["block_start"] + b, len(a) // 4, zlib.crc32(a)) for i, b, a in documents_of(row, press)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in slices(batches):
        sizes = [int(np.frombuffer(c, "<u4").sum(dtype=np.int64)) for c in some.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64())], names=["shard", "ids"])


def read_documents(spark: SparkSession, out: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents: only blocks whose range holds them are read, only their frames decompressed."""
    _, raw = _load_dictionary(spark, out)
    wanted = set(doc_ids)
    where = F.lit(False)
    for i in wanted:
        where = where | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    press, found = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), {}
    for row in spark.read.parquet(f"{out}/blocks").where(where).toLocalIterator():
        found.update((i, np.frombuffer(a, "<u4").tolist()) for i, _, a in documents_of(row.asDict(), press, wanted))
    return found


def encode_and_index(documents: DataFrame, out: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    return read_index(spark, write_store(documents, out or new_path(spark, "token-store"), tokenizer_path))
